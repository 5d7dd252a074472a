"""Readers and writers of alignment, annotation and event files."""
