"""Raster analytics on Spark: pixels and tiles as DataFrames."""
