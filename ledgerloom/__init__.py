"""PySpark-native analytics over auditable record pipelines."""
