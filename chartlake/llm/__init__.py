"""Operators for large-scale text-corpus preparation.

Nothing outside this subpackage imports it; ``queries`` registers one query per operator.
"""
