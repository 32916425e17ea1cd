"""Operators over steps, cases and verdicts."""
