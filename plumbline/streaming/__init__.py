"""Incremental counts; the batch operators don't need them."""
