"""Connectors that turn source tables into staged people."""
