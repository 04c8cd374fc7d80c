"""Readers: dataset folders, markdown trees, EPUB containers, HTML pages."""
