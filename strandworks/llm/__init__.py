"""Operators on corpora for language models.  Nothing outside this package imports it."""
