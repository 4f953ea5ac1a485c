"""Scalar functions as column expressions: codecs, hashes, keys and filters."""
