"""Keyed event state, in batch and as a stream."""
