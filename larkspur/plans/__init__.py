"""Statements: from text to a tree, and from the tree to a DataFrame."""
