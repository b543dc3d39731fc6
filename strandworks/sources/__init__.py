"""Readers and writers of the text formats, and stubs for remote services."""
