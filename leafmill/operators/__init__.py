"""Relational, search and incremental operators."""
