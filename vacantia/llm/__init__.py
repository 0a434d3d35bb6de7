"""Operators that prepare a corpus of documents for training language models."""
