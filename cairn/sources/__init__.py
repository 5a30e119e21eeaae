"""Readers and writers of point and splat files."""
