"""Readers, writers and stored-table maintenance."""
