"""Readers, writers and the views that give the driver's test tables their roles."""
