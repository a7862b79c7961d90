"""operators of granary."""
