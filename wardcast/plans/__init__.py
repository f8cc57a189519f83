"""Whole-forecast plans built from the operators."""
