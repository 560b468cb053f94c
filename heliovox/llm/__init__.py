"""Operators that prepare text and aligned records for training language models."""
