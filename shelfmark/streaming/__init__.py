"""Structured Streaming over the file sources: running counters of users, and appends at a limited rate."""
