"""Readers: Parquet tables, vault folders, saved pages, tool output."""
