"""DataFrame to DataFrame analytics."""
