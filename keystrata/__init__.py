"""Versioned key-document engine on Spark DataFrames."""
