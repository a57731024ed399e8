"""Corpus-preparation operators for training data."""
