"""Readers of text corpora and n-gram tables."""
