"""Streaming counterparts of the batch analyses."""
