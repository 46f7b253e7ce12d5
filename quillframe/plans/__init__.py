"""Text to syntax trees, and the catalog."""
