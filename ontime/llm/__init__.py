"""Operators for preparing training text: dedup, mixing, filters, scans, archives, tokens.

Nothing outside this folder imports it; the folder can be removed and the rest still works.
"""
