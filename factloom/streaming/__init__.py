"""Incremental jobs over files that keep arriving."""
