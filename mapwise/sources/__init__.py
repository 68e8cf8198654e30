"""Readers, writers and the adapter views over the star-schema test tables."""
