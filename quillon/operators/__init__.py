"""Look-ups, gap lists and rankings over an index."""
