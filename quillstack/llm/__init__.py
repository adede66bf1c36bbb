"""Training-data operators: language ID, BPE, top-k search, near-duplicate detection, PII and friends.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
