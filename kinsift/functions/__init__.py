"""Column functions and Python functions on single documents."""
