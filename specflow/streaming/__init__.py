"""Structured Streaming: file polls, windows, deduplication, intake and keyed state."""
