"""Operators for building training corpora: counting, searching, mixing, cleaning, writing.

Nothing outside this subpackage imports it.
"""
