"""Romanization and script analytics on Spark DataFrames."""
