"""Operators for training-data pipelines: scoring, dedup, packing, tokenizing, search.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
