"""Change streams: batch fold, Structured Streaming sinks, event-time windows."""
