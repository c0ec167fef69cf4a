"""Readers and writers of evidence."""
