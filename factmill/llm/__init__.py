"""Operators that a large training-data pipeline needs.

Nothing else in ``factmill`` imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries.py`` registers one thin
``opN_<name>`` query for each of them.
"""
