"""Structured Streaming ingestion and quota admission."""
