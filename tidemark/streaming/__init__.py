"""Structured Streaming: refresh with late data, tumbling aggregates, upserts."""
