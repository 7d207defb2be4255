"""streaming of the feed engine."""
