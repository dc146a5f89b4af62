"""Structured Streaming: watched folders and backfills."""
