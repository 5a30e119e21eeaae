"""Query catalogue and fixtures."""
