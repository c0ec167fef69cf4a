"""Streaming forms of the detections. Each has a batch operator with the same result."""
