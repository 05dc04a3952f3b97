"""Readers, writers, change feeds and bookmarks."""
