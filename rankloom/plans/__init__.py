"""Workflows of several operators."""
