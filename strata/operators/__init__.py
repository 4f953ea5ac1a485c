"""Operators on changelogs, batches, file tables and manifests."""
