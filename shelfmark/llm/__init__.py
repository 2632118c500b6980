"""Operators for preparing large training corpora: language id, media columns, deduplication, packing, tokenizing, sharding, WARC.

Nothing outside this folder imports it; ``queries.py`` holds what the entry module registers.
"""
