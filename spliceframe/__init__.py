"""Transcriptome quantification as Spark jobs."""
