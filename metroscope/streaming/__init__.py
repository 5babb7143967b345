"""Structured Streaming jobs over a landing folder of raw feed responses."""
