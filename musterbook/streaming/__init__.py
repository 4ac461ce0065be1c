"""Intentionally empty: the domain has no stream, watermark or state (see README)."""
