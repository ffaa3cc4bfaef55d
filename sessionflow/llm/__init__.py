"""Operators for preparing training text: deduplication, filtering, packing.

One module per operator; ``queries.py`` holds the thin registered queries.
Nothing else in the package imports this subpackage.
"""
