"""A PySpark-native analytics engine: tables in, DataFrames out, Catalyst in between."""
