"""Training-data operators: secrets, tokens, PII, near duplicates, quality.

Nothing outside this subpackage imports it.
"""
