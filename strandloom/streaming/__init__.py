"""Incremental counterparts of the batch sums; the engine itself needs no stream."""
