"""Operators of a training-data pipeline: search, mixing, deduplication, filters, packing, archives.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
