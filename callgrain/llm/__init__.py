"""Operators that prepare a text corpus for the training of language models."""
