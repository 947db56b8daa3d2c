"""Incremental and streaming entry points."""
