"""Readers and writers: CSV rows, attached files, parquet tables, CSV export."""
