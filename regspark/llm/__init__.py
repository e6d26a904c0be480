"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this package. ``queries`` registers one
query per operator; the operators themselves take and return DataFrames.
"""
