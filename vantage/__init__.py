"""vantage: a PySpark engine for code-graph exposure analysis and training-data preparation."""
