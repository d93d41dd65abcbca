"""Readers that turn files and archives into tables."""
