"""Relational operators over the ledger tables."""
