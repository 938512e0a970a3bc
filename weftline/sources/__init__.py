"""Readers and writers: input tables, text files, published versions, snapshots."""
