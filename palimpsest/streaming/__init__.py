"""Scans of a stream of files."""
