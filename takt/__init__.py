"""takt: production-line event analytics as plain DataFrame -> DataFrame functions on Spark."""
