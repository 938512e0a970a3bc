"""Spark jobs over sectioned text, vector indexes and account records."""
