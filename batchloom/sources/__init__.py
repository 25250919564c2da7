"""Readers for manifests, listings, configurations, messages and tables."""
