"""Operators for preparing language-model training text.

Each module holds one operator with its own general interface; `queries`
registers the thin queries over the standard tables and their SQL.
"""
