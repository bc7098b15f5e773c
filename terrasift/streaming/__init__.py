"""Structured Streaming: progress events, chunking, delta detection, windows."""
