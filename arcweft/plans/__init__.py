"""Loops that Catalyst does not have."""
