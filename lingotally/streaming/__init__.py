"""Structured Streaming operators; they reuse the batch functions."""
