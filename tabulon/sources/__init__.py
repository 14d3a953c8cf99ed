"""Readers and writers of table files."""
