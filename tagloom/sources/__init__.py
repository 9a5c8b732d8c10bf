"""Readers and writers for stage tables, result files and sample sets."""
