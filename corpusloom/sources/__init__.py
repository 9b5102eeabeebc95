"""Readers and writers of documents, chunks, cases and reports."""
