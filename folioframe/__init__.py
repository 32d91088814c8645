"""Scholarly-corpus analytics as plain Spark DataFrame jobs."""
