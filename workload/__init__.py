"""Telemetry-shaped views over the given tables, the query catalogue and its SQL counterparts."""
