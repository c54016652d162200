"""Training-data operators (deduplication, filtering, mixing, packing, archives).

Nothing else in the library imports this subpackage.
"""
