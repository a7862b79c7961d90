"""sources of granary."""
