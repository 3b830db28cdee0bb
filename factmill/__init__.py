"""Grounded plan analytics and training-data operators on Spark."""
