"""Readers, writers, and the places for tables between jobs."""
