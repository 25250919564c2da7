"""Structured Streaming jobs. Every sink write is repeatable per micro-batch."""
