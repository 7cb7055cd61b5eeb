"""Monitoring of a growing log."""
