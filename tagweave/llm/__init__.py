"""Operators for preparing training corpora, their queries and SQL.

Nothing outside this subpackage imports it.
"""
