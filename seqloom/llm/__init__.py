"""Operators that prepare large training collections.

Nothing outside this subpackage imports it; its queries are registered by
`queries.py` and `sql.py`.
"""
