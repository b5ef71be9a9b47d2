"""Operators for preparing training text: thirteen corpus operators, their queries and their SQL."""
