"""Marlstone: a small relational engine whose plans are Spark DataFrames."""
