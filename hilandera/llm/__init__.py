"""Operators that prepare text and vectors for the training of language models.

Nothing outside this folder (but for corpus_pipeline.py) imports it.
"""
