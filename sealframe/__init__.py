"""A PySpark engine for sealed tables: encrypted, verifiable archives as DataFrames."""
