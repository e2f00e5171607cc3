"""Keeping and searching large collections of messages, documents and pages on Spark."""
