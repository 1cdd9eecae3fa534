"""Relational operators beyond the built-in ones: guarded runs, comparison, curation, evaluation, routing."""
