"""Readers and writers for tables, metadata and result files."""
