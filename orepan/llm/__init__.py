"""Training-data operators: token files, search, filters, sharding, dedup, packing.

Nothing outside this subpackage imports it; it imports nothing outside itself.
"""
