"""Operators of a training-data pipeline over a ``documents`` table.

Ten operators (sharding, quality rules, packing, sentence pieces, paragraph
dedup, run-length substring dedup, ORC token files, BM25 search, toxicity,
near-dedup).  Their named queries are in ``seqlens.llm.entry``; nothing else
in the library imports this subpackage.
"""
