"""Operators for large text corpora: tokenising, classifying, deduplicating, scanning and mixing documents.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
