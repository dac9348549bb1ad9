"""Readers and writers: CSV input, Parquet tables, CSV reports."""
