"""Synth of the media analytics engine."""
