"""Operators for building training corpora: de-duplication, quality, language models, secrets, packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
