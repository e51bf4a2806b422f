"""Operators for preparing large text corpora: deduplication, tokenising,
classifiers, retrieval and decontamination.  Nothing outside this folder and
``corpus_pipeline.py`` imports it."""
