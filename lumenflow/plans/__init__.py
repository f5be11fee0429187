"""Plans of the media analytics engine."""
