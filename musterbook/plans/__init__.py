"""Composite jobs: the monthly summary and the personal calendar."""
