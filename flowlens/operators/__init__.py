"""operators of the broker-flow engine."""
