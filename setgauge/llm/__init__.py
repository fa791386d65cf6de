"""Operators of a training-data pipeline: filtering, deduplication, mixing, formatting, tokens.

Nothing outside this package imports it.
"""
