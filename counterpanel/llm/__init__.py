"""Operators of a training-data pipeline: dedup, cleaning, mixing, encoding.

Nothing else in the library imports this subpackage; its queries are added by
the entry module when the subpackage is present.
"""
