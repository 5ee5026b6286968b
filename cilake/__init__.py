"""cilake: CI telemetry (logs, env files, matrices, workflow documents) as Spark tables and streams."""
