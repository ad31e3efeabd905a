"""Typed scalar expressions of the dialect."""
