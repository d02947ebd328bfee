"""Whole queries composed of the operators."""
