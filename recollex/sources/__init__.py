"""Readers and writers of record databases, text corpora and models."""
