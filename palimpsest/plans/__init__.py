"""Whole scans, reports and the registered queries."""
