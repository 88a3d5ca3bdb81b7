"""Operators on triples, graph tables and binding tables."""
