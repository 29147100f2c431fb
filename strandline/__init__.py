"""Frame-stream analytics on PySpark: stages, hooks, detection algebra, control tables."""
