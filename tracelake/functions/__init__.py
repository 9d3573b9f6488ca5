"""Functions of the record engine."""
