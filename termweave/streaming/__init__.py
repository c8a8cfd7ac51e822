"""Incremental mapping of arriving records (an addition of this library)."""
