"""Readers and writers: XML records, JSON lines, line geometry, manifests."""
