"""Schemas and the plans that rebuild a version."""
