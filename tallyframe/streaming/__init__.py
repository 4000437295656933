"""Row-level operators on file streams."""
