"""Operators for large text corpora: filtering, deduplication, tokenisation, privacy.

Nothing outside this folder imports it. ``queries`` holds the registered queries.
"""
