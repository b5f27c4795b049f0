"""Readers of archives and manifests."""
