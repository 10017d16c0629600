"""Structured Streaming: blocks from growing inputs, and following a folder."""
