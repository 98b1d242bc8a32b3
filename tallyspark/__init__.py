"""Rule-driven analysis of tagged, period-stamped facts on Spark."""
