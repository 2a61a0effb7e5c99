"""Structured Streaming variants of ingestion and telemetry."""
