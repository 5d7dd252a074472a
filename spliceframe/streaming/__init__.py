"""Incremental runs over arriving alignments."""
