"""Bibliographic analytics as Spark DataFrames."""
