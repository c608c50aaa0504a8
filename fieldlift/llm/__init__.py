"""Training-data operators: deduplication, scoring, mixing, packing and token or media output.

Nothing else in the library imports this subpackage.
"""
