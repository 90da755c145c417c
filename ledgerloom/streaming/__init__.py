"""Streams over documents and stage events."""
