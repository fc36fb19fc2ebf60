"""The modem metadata path as Structured Streaming jobs."""
