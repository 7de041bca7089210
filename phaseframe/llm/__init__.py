"""Operators of a training-data pipeline: ten components over documents, conversations and embeddings.

Nothing else in the library imports this subpackage.
"""
