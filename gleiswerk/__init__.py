"""Spark jobs for railway punctuality data."""
