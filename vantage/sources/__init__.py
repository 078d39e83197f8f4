"""Sources of relations."""
