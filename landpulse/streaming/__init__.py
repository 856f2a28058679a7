"""Continuous intake of notification files."""
