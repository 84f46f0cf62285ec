"""Readers and writers for dataset documents, CSV inputs and landed payloads."""
