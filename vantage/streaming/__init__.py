"""Incremental analysis of arriving snapshots."""
