"""Sinks: tables and files that are published as a whole or not at all."""
