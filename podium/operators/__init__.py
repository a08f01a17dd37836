"""The standings operators."""
