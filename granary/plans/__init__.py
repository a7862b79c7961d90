"""plans of granary."""
