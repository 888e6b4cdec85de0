"""Structured Streaming: windowed aggregates and the job queue as state. These go beyond the batch engine."""
