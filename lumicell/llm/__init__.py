"""Operators for preparing training corpora, beside the cell-phenotyping library.

Nothing outside this package imports it.  Each module holds one operator with its own general
interface; ``queries`` holds the thin registered queries and their SQL.
"""
