"""Operators for building training corpora (quality, deduplication, mixing, tokens, archives).

Nothing else in the library imports this subpackage.
"""
