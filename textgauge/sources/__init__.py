"""Readers, writers and the bookkeeping of runs."""
