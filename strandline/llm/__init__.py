"""Operators for preparing training text: filtering, near-duplicates, sharding, scoring and encoding.

Nothing outside this package imports it.
"""
