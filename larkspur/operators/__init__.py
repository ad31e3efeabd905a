"""Relational operators of the dialect as DataFrame steps."""
