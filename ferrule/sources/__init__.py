"""Scans of files and text."""
