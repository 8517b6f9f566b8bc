"""Training-data operators: near-duplicates, tokenisation, language, extraction, scoring, privacy and quality.

Nothing else in the library imports this subpackage.
"""
