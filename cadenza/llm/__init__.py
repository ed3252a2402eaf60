"""Operators for preparing training text: filtering, near-duplicate removal, tokens, packing, sharding.

Nothing outside this subpackage imports it.
"""
