"""Functions of the versioned document engine."""
