"""A search and analytics engine for document collections, built on Spark DataFrames."""
