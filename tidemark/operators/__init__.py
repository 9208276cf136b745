"""Relational building blocks: ingestion, serving, geocoding, similarity, clustering."""
