"""A PySpark-native analytics engine: plain functions over DataFrames."""
