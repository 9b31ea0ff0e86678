"""Stability over a stream: an addition, not part of the batch contract."""
