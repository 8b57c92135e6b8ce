"""Lapidary: curation of short texts as Spark jobs."""
