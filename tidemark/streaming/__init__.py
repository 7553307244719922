"""Incremental projection of change batches into keyed state."""
