"""Operators that large-scale training-data pipelines need.

Nothing outside this package imports it.  Each module holds one operator
with a general interface; :mod:`plexigraph.llm.queries` holds the thin,
contract-bound queries.
"""
