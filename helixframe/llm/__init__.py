"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; ``queries`` registers the thin queries over the
test tables.
"""
