"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; `queries.py` holds the thin queries
that bind each operator to the driver's tables.
"""
