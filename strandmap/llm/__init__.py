"""Training-data operators: cleaning, deduplication, encoding and packing of text corpora.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
