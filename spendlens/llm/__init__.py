"""Operators for building training corpora out of documents, labels and logged conversations."""
