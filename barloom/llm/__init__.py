"""Operators for large text and vector collections: scans, tokens, scores, packing, joins and searches."""
