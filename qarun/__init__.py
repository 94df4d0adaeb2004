"""Question runs on Spark: ask, log and report."""
