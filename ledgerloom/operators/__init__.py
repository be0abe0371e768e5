"""Relational operators over ledgers, graphs and profiles."""
