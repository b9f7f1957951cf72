"""Readers, writers, generators and response ingestion."""
