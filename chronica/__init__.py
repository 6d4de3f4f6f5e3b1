"""Longitudinal life-event analytics on Spark DataFrames."""
