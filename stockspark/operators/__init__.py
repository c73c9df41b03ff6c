"""Operators: DataFrame(s) + config in, lazy DataFrame(s) out."""
