"""Training-data operators: deduplication, licences, extraction, tokens, language, quality.

Nothing outside this subpackage imports it.
"""
