"""Readers, sinks and the storage layout."""
