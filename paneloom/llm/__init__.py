"""Operators for large training-text tables, and the queries that apply them.

Nothing outside this folder imports it, so it can be taken away as a whole.
"""
