"""Scans, header mapping and sinks."""
