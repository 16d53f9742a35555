"""Whole queries: the public pipeline and the query catalogue."""
