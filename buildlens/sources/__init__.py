"""Readers that turn CI artifacts into typed tables."""
