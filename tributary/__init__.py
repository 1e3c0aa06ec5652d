"""Tributary: dependency-graph analytics on PySpark DataFrames."""
