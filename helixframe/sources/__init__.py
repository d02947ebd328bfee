"""Readers of sequence and alignment formats, and views of tables as sequences."""
