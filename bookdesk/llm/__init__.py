"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder, ``tests/llm`` and
``corpus_pipeline.py`` imports it. ``queries.py`` registers one query per
operator."""
