"""Relational and spatial operators over point tables."""
