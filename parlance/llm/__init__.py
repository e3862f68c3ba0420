"""Operators of a large corpus pipeline. Nothing else in ``parlance`` imports this package."""
