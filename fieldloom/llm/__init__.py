"""Training-data operators: scoring, fingerprints, scans, tokenising, packing, deduplication, media.

Nothing outside this subpackage (and the top-level ``corpus_pipeline.py``) imports it.
"""
