"""Structured Streaming into stripe tables."""
