"""Operators for building training corpora: extraction, quality, deduplication, tokens, packing, archives.

Nothing else in the library imports this subpackage.
"""
