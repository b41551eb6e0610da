"""Training-data operators: tokenising, deduplication, search, extraction, filtering, mixing.

Nothing outside this folder imports it.
"""
