"""Operators for preparing training corpora: fingerprints, decontamination, joins, extraction, packing, classifiers.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
