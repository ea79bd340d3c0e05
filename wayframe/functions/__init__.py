"""Column functions: geography, text, aggregates."""
