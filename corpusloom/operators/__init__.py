"""Relational operators over exploded cells and dataset records."""
