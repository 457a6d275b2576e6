"""Operators for preparing training text: dedup, scoring, filtering, packing, extraction.

Nothing else in the package imports this one.  ``queries.py`` holds the registered
queries, every other module one operator.
"""
