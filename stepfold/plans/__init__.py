"""Whole plans: from raw logs to verdicts, and the queries over the driver's tables."""
