"""Readers of landed files, dimensions, and partitioned writers."""
