"""Incremental delivery of session documents."""
