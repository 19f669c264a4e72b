"""Literals, patterns, fields and statistics as Spark expressions."""
