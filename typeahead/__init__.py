"""Autocompletion and query suggestion for whole sets of queries, on Spark."""
