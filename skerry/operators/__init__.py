"""Detectors: column plans and kernels."""
