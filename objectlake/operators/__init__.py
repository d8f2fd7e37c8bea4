"""Operators on DataFrames: queries, change logs, catalogs, ids."""
