"""Micro-batch ingest with idempotent replay."""
