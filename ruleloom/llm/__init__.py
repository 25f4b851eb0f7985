"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds the operators to the standard
tables.
"""
