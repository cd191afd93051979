"""Genomic-interval and point-event analytics on Spark DataFrames."""
