"""Training-data operators: scoring, packing, search, mixing, extraction and deduplication.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
