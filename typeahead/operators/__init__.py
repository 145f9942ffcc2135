"""Retrieval, correction, ranking and merge operators over DataFrames."""
