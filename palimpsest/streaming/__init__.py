"""Commits from streams."""
