"""Raster features and thematic mapping on Spark DataFrames."""
