"""Plans of the versioned document engine."""
