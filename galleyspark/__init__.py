"""Editorial-content analytics as PySpark jobs: DataFrames in, DataFrames out."""
