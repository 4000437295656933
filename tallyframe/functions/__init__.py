"""Column expressions: no function here triggers a job or needs a Python worker."""
