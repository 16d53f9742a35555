"""Incremental forms over streams of counts."""
