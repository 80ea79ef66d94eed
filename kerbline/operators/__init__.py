"""Kerbline: operators."""
