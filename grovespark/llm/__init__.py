"""Operators for text of training corpora. Nothing outside this package imports it."""
