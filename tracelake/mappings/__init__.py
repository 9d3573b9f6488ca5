"""App databases, as tables of decoded rows, to records: one module for each family, and their registry."""
