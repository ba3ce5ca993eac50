"""Readers and writers: record files, journals, session logs with byte positions, listings."""
