"""Spark-first analytics for sites, pages, links and texts."""
