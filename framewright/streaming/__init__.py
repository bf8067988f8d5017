"""Structured Streaming forms of the engine's stateful parts."""
