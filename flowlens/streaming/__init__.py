"""Structured Streaming jobs: ingest, fan-out, watermarked windows, sessions, dedup."""
