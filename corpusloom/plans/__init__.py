"""Whole plans from the operators: ingestion, hybrid search, evaluation."""
