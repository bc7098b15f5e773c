"""Terrasift: guarded read-only SQL, spatial and text retrieval, and operational analytics over Spark DataFrames."""
