"""Readers: repository files, documents, version-control logs, code and exported analyses."""
