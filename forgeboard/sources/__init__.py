"""Schemas, payload parsing and versioned snapshots."""
