"""Corpus operators for preparing training data at cluster scale."""
