"""Event-log analytics on Spark: command logs, replicated-log rules, telemetry."""
