"""Operators for preparing training corpora, each over Spark DataFrames."""
