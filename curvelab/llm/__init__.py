"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; it may be removed with
its tests and ``corpus_pipeline.py`` and the rest goes on working.
"""
