"""Operators for preparing training data from text at scale."""
