"""Readers that yield transaction tables."""
