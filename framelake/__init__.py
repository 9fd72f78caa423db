"""framelake: analytics over time-based media tables, written as PySpark DataFrames."""
