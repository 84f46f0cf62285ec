"""Training-data operators: deduplication, language, formatting, extraction, secrets, mixing.

Nothing else in the library imports this subpackage; it may use general helpers of the library.
"""
