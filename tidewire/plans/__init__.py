"""plans of the feed engine."""
