"""Readers of raw episode folders, readers and writers of processed tables."""
