"""Tapeloom: replayed-tape market analytics on Spark DataFrames."""
