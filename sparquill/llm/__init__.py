"""Operators of a training-data pipeline.

Nothing outside this folder imports it.  Each module holds one operator with
a general interface; ``catalog`` registers the thin ``opN_<name>`` queries.
"""
