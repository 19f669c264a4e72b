"""The same predicates over streams."""
