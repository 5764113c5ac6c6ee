"""Functions of corvane."""
