"""operators of the feed engine."""
