"""Relational operators: triples, spans, networks, samples, evaluation."""
