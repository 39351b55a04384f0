"""Operators for preparing training data: tokens, near copies, packing, filters."""
