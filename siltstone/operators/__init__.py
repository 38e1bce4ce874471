"""Operators over catalogs, names, sketches and vectors."""
