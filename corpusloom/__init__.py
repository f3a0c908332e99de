"""A document-corpus analytics engine on Spark DataFrames."""
