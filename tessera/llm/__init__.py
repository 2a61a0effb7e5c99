"""Operators of a training-data pipeline: token counts, BPE, decontamination, toxicity, HTML
extraction, chat formatting, quality scores, near-duplicates, binary token files, quality rules, prefix tries,
line deduplication, source divergence.

Nothing else in the library imports this subpackage.
"""
