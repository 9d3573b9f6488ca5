"""Operators of the record engine."""
