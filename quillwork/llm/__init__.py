"""Operators that prepare language-model training data. Nothing outside this package imports it."""
