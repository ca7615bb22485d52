"""Structured Streaming over alignments and reads that arrive as files."""
