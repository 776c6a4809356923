"""Versetide: poem recommendation as Spark batch and streaming jobs."""
