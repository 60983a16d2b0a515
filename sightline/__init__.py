"""Sightline: web-evidence analytics and corpus preparation as Spark jobs."""
