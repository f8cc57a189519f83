"""DataFrame operators of the forecast."""
