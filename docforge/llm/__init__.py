"""Training-data operators: tokenizing, search, dedup, scoring, extraction, archives.

Nothing outside this sub-package imports it.
"""
