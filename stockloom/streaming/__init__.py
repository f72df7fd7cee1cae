"""Structured Streaming forms of the scoring and alert jobs."""
