"""Joins, deduplication, sampling and metrics over whole tables."""
