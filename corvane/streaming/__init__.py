"""Streaming of corvane."""
