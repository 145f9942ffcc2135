"""Scalar text functions: Spark columns, and the few that need Python."""
