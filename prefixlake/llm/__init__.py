"""Operators for preparing training data: ten jobs over documents, pages and vectors.

Nothing else in the library imports this package.
"""
