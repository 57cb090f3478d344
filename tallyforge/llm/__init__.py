"""Operators for preparing training data: language ID, near copies, nearest vectors, tokens, secrets, packing."""
