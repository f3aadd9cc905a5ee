"""Multimodal training-data preparation and evaluation on Spark DataFrames."""
