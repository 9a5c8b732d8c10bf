"""Structured Streaming variants of the stateless and event-keyed operators."""
