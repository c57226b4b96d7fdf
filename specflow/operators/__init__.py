"""Relational operators over spectra, metadata and model tables."""
