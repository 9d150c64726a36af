"""Adapters, the end-to-end plan and the query registry."""
