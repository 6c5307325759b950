"""Operators for preparing training text at scale, with their registered queries and SQL."""
