"""Structured Streaming jobs over request feeds and logs."""
