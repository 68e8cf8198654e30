"""Outcome-mapping analytics as Spark jobs over all programs, courses and documents at once."""
