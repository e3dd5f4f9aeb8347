"""Operators that prepare training data for language models.

Nothing outside this folder imports it; it can be removed without touching
the reconciliation side of the library.
"""
