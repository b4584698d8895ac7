"""Live maintenance on Structured Streaming."""
