"""Whole-corpus code-graph and versioned-text analytics as Spark jobs."""
