"""Training-data operators: tokenising, filtering, deduplication and formatting of text at corpus scale.

Nothing outside this package imports it, and it imports nothing of the vector library.
"""
