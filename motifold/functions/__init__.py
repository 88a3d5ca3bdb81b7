"""Column-level helpers: term tests, pattern arguments, property-bag tests."""
