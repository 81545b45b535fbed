"""Readers, writers and the impression view over an event log."""
