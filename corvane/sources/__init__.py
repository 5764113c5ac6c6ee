"""Sources of corvane."""
