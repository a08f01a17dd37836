"""Readers, writers and standings-shaped views."""
