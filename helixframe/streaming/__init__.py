"""Queries as streams against a static reference."""
