"""Scalar functions over sequences."""
