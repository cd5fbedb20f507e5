"""Whole experiments and the queries over the test tables."""
