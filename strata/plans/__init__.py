"""Policies over metadata: which files a compaction takes."""
