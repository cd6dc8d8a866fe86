"""Parsing, filtering, paging and tracing as DataFrame transformations."""
