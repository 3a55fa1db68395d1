"""Operators for building training data: scoring, deduplication, packing, formatting and mixing of documents.

Each module holds one operator with its own general interface; ``queries`` has the registered queries.
Nothing outside this subpackage imports it.
"""
