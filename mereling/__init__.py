"""Spark-native analysis of stacks of multi-band rasters, and of the tables around them."""
