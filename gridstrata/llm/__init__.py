"""Operators of a training-data pipeline over the tables documents, labels and embeddings.

``queries`` registers them; nothing else in the library imports this subpackage.
"""
