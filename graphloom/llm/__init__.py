"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every module states what its
operator does with nulls, empty tables, repeated rows and ties.
"""
