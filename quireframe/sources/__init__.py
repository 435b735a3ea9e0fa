"""Readers and projections."""
