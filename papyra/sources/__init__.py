"""Readers of files and of rendered business documents."""
