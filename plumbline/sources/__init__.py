"""Readers, writers and the model folder."""
