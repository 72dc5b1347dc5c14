"""Schema-driven device-log analytics on Spark."""
