"""Operators for preparing training text: filtering, de-duplication, auditing, encoding and scoring."""
