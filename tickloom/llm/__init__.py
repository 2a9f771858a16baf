"""Operators of a training-data pipeline over documents, labels and embeddings.

Nothing else in the library imports this subpackage.
"""
