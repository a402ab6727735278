"""Sources of the versioned document engine."""
