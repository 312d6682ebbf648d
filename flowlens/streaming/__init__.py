"""streaming of the broker-flow engine."""
