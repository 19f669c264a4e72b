"""Operators over events, rules and hits."""
