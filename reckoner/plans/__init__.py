"""Whole runs, and the registry of queries with their SQL."""
