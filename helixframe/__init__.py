"""Comparison of large collections of sequences (DNA, protein or text) on Spark."""
