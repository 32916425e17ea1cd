"""Structured Streaming: the state of cases as their steps arrive."""
