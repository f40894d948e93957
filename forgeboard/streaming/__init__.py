"""Structured Streaming delivery of payload files."""
