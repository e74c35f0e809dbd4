"""Operators for large text corpora: scoring, de-duplication, search, mixing, tokens.

Nothing outside this package imports it; its queries are in ``llm.queries``.
"""
