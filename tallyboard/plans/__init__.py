"""Whole flows, and the queries over the shared test tables."""
