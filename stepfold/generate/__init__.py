"""Generators of labelled cases: mutations of observed logs, and rule families from pools."""
