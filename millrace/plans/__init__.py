"""Helpers that shape physical plans, and the registry of queries."""
