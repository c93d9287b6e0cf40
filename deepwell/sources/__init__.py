"""Readers, parsers and the versioned store."""
