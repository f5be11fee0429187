"""Sources of the media analytics engine."""
