"""Column expressions and small numeric helpers used inside Spark tasks."""
