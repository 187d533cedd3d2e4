"""Readers and writers of the binary wire form."""
