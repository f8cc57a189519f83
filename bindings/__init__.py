"""Runs the forecast on order-and-line test tables."""
