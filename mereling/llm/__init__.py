"""Operators of a training-data pipeline: each module is one operator over a table of texts.

Nothing else in the library imports this subpackage; `queries.py` binds the operators to the
driver's tables.
"""
