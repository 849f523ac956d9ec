"""Graphs from files and tables."""
