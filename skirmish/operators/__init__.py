"""Relational and custom operators."""
