"""Sinks: reports and diagnostics."""
