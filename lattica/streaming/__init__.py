"""Streaming of the lattica engine."""
