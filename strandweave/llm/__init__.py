"""Operators on texts and sequences for language-model corpora. Nothing outside this package imports it."""
