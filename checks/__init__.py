"""Registered queries and their SQL counterparts over the derived tables."""
