"""Readers and writers for flow, alert, whitelist and report tables."""
