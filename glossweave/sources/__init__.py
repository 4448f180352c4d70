"""Readers for the public corpora and the sinks for the built tables."""
