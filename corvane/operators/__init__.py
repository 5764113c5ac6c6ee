"""Operators of corvane."""
