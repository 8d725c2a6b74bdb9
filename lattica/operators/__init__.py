"""Operators of the lattica engine."""
