"""Readers and projections that bring raw inputs into the engine's tables."""
