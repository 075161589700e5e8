"""Readers and stream order."""
