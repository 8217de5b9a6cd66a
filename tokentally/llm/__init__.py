"""Operators for preparing training data, built on Spark jobs with vectorised helpers in tasks."""
