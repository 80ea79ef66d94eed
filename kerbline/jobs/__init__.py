"""Kerbline: jobs."""
