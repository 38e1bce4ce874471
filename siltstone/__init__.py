"""Corpus curation on Spark: catalog, duplicates, provenance, views, similarity and plans."""
