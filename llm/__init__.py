"""Operators for large training-text corpora; nothing else in this repository imports them."""
