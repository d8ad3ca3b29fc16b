"""Operators for preparing large text corpora, each a function over Spark DataFrames."""
