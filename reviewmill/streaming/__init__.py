"""File intake and vector upserts with Structured Streaming."""
