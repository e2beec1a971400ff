"""Column functions: text, dates, identifiers."""
