"""sources of the feed engine."""
