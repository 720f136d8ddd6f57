"""Training-data operators: tokenising, privacy, de-duplication, quality, mixing and scoring.

Nothing outside this subpackage imports it.
"""
