"""Training-data operators: filtering, deduplication, tokenising, scoring and sharding of text corpora.

Nothing else in the library imports this subpackage.
"""
