"""Composed plans: fixture views, corpus build, profile and evaluation flows,
and the query registry used by ``__spark_entry__``."""
