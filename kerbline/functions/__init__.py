"""Kerbline: functions."""
