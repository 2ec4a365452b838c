"""flowloom: network-flow telemetry analytics as Spark DataFrame jobs."""
