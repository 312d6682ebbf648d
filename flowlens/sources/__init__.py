"""sources of the broker-flow engine."""
