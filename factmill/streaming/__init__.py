"""Incremental versions of batch operators."""
