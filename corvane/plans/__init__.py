"""Plans of corvane."""
