"""Cleaning and analysis of station time series on Spark: import, alignment, quality control, gap filling, analysis."""
