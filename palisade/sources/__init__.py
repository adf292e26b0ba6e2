"""Readers for files, result tables and log streams."""
