"""Operators for training-data pipelines: counting, deduplication, packing, search and extraction.

Nothing else in the library imports this subpackage. ``registry`` lists its queries.
"""
