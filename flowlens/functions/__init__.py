"""functions of the broker-flow engine."""
