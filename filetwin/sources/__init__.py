"""Listing, fingerprinting and durable catalog tables."""
