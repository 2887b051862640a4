"""Operators for building training data from a document corpus.

Nothing outside this folder imports it. Each module holds one operator with its
general interface and the thin ``opN_*`` query that applies it to the tables.
"""
