"""Whole runs, from files to result tables."""
