"""Tabular profiling, feature and retrieval engine on PySpark DataFrames."""
