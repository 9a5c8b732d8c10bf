"""Bindings of the operators to the star-schema tables, and the query catalogue."""
