"""Readers of resources."""
