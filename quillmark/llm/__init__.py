"""Training-data operators: dedup, filtering, mixing, packing, linking and scoring.

Nothing else in the library imports this subpackage.
"""
