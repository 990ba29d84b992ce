"""Readers and writers of the evaluation pipeline's files."""
