"""Streaming of the media analytics engine."""
