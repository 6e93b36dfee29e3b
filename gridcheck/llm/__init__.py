"""Operators for large training-text corpora.

Each module holds one operator with its own general interface; ``queries``
binds them to the tables of a data directory.  Nothing outside this package
imports it.
"""
