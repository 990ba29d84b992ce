"""Operators over paged vector data, each from DataFrame to DataFrame."""
