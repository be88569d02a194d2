"""Readers for landed files and the catalog (tables, sinks)."""
