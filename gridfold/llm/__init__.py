"""Training-data operators: deduplication, tokens, packing, quality, sharding.

Nothing else in the library imports this subpackage.
"""
