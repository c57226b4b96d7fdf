"""Readers, writers and driver-table adapters."""
