"""Fixtures and the registered queries."""
