"""Structured Streaming over changelogs."""
