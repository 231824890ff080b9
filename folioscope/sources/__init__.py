"""Readers, writers and exports."""
