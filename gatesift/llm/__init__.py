"""Operators for training corpora: cleaning, searching, counting, packing and formatting text."""
