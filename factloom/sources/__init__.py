"""Readers and writers: definitions, submissions, tables, JSONL and HTML."""
