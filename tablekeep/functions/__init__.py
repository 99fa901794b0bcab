"""Scalar functions. Every one takes and returns Columns; none is a Python UDF."""
