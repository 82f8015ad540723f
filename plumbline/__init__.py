"""Table quality measured with Spark: profiles, outliers, readiness, diffs, lineage."""

__version__ = "0.1.0"
