"""Readers and writers of sequence files and tables."""
