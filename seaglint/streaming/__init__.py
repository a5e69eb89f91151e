"""Structured Streaming jobs over landed event files."""
