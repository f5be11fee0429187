"""Operators of the media analytics engine."""
