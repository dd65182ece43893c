"""Relational stages, one module per job."""
