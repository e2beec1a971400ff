"""Readers and writers: XML letters, Turtle, stores, JSON files, tables."""
