"""Plans of the lattica engine."""
