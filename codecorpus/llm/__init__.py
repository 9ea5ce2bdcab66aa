"""Training-data operators: mixing, deduplication, scans, language, extraction, quality and licences.

Nothing outside this subpackage imports it.
"""
