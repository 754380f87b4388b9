"""Training-data operators: packing, counting, de-duplication, quality, sharding, formatting, WARC.

Nothing else in the library imports this subpackage.
"""
