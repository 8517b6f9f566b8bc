"""Structured Streaming into tables, and their change log as a stream."""
