"""Operators on long, sparse counts and on what is fitted to them."""
