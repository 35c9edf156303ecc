"""Abuse detection over web access logs, as Spark jobs."""
