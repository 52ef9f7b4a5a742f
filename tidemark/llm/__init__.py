"""Operators for preparing training data: archives, privacy, cleaning, deduplication, mixing, scoring and search.

Nothing else in the library imports this subpackage.  Every operator has a general interface (DataFrames in, DataFrames
out); the modules also hold the thin ``opN_*`` queries that `queries.py` registers.
"""
