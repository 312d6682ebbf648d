"""plans of the broker-flow engine."""
