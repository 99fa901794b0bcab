"""Readers that turn outside data into DataFrames."""
