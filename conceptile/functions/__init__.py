"""Scalar functions as expressions, and the two that need Python."""
