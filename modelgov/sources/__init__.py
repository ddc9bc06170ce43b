"""Readers: definition text, report JSON, containers and tabular relations."""
