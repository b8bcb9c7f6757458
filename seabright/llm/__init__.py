"""Operators for large text corpora: filtering, search, packing, tokenising, deduplication.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
