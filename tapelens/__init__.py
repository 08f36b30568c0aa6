"""tapelens: market-signal analytics as Spark DataFrame operators."""
