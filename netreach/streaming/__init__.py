"""Structured Streaming forms of the additive aggregates."""
