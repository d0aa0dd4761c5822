"""Incremental arrival of months."""
