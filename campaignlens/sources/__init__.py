"""Readers and writers of fact documents."""
