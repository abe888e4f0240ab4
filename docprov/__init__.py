"""Spark-first engine for document-release provenance: attribute leaks, audit releases, check marks."""
