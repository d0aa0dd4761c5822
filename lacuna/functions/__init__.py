"""Catalyst expressions and metrics."""
