"""Readers of the driver tables and of rule files."""
