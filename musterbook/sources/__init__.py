"""Readers, writers and the tables derived for checks."""
