"""Spark-first analytics over crisis reports, claims and their evidence."""
