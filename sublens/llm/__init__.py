"""Operators for training-data pipelines, one module per operator.

Nothing else in the library imports this subpackage; `queries.py` lists its registered queries.
"""
