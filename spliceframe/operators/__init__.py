"""Joins, aggregates and scans over interval tables."""
