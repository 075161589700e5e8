"""Meters, score operators, vectors, metrics and numerics."""
