"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface; ``queries.py`` holds the thin registered queries.
"""
