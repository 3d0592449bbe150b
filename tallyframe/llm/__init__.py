"""Corpus operators: private data, duplicates, mixing, scoring, classification and token output."""
