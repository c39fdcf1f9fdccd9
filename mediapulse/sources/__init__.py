"""Readers of theme files, article lists, volumes and dimensions, and writers of keyed tables."""
