"""Polar marine analytics as Spark jobs over DataFrames."""
