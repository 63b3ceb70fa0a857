"""Counts of event streams."""
