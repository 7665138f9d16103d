"""Spark jobs over ordered, keyed tables and streams."""
