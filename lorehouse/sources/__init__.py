"""Readers, page extraction, URL rules and sinks."""
