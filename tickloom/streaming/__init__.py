"""Structured Streaming: sources, windows, stateful rules and idempotent sinks."""
