"""Structured Streaming versions of detectors."""
