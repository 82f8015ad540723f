"""Column-level building blocks: type families, missing values, text tests, formatting."""
