"""Fragmented messages, in batches and streams."""
