"""Incremental variants of the ingest operators (an extension)."""
