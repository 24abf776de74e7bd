"""Spark jobs for media-delivery data: requests, assets, caches and images."""
