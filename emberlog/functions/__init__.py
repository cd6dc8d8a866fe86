"""Scalar functions as Columns, with driver-side twins for single values."""
