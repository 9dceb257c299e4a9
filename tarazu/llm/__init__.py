"""Operators for training text.  Nothing outside this sub-package imports it."""
