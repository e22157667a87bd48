"""Joins, blocking, sampling, features and other operators over DataFrames."""
