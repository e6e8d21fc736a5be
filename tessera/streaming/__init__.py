"""Structured Streaming forms of the engine's incremental work."""
