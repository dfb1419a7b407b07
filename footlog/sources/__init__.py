"""Readers and writers: the event table, request bodies, imported history and recordings."""
