"""Incremental maintenance over append-only streams."""
