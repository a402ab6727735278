"""Streaming of the versioned document engine."""
