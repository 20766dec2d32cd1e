"""Notebook and document dataset engine on Spark."""
