"""Column functions: every one takes and returns Spark columns."""
