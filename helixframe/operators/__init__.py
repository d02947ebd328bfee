"""Operators over sequences, matches and alignments."""
