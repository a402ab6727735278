"""Operators of the versioned document engine."""
