"""Queries on the driver tables, and the same results stated in plain SQL."""
