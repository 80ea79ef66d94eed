"""Kerbline: streaming."""
