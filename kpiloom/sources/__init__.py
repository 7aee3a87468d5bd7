"""Scans, upload admission, staging, catalog files and sinks."""
