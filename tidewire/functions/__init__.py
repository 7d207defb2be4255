"""functions of the feed engine."""
