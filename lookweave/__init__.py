"""Outfit analytics as Spark jobs."""
