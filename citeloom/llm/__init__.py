"""Operators of a training-data pipeline: deduplication, filtering, counting, packing.

Nothing outside this subpackage imports it.
"""
