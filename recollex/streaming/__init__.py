"""Incremental forms of the batch operators, on Structured Streaming with checkpoints in the shared folder."""
