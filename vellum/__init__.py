"""A PySpark-native engine for Markdown vaults, captured threads, pages and PDF text."""

__version__ = "0.1.0"
