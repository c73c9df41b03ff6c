"""Operators of a training-data pipeline over ``documents``-like tables.

One module per operator; ``queries`` registers one thin query for each of
them. Nothing else in the library imports this subpackage.
"""
