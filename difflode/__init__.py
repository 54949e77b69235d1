"""Spark-first analytics for labelled text-and-diff datasets."""
