"""Scans: Parquet tables, files of documents, bibliographic exports."""

from foliospark.sources.tables import read_table

__all__ = ["read_table"]
