"""Readers for the tables that the queries run over."""

from sightline.sources.tables import read_table

__all__ = ["read_table"]
