"""The same stages over Structured Streaming."""
