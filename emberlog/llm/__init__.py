"""Operators for preparing training text: near duplicates, packing, scoring, scans.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
