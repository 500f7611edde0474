"""Operators for large text corpora that feed language-model training.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
