"""Kerbline: sources."""
