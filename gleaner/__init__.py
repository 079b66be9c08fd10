"""Gleaner: query-focused excerpt extraction and corpus preparation on PySpark."""
