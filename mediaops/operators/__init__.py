"""Operators on request, asset, cache and image tables."""
