"""Functions of the media analytics engine."""
