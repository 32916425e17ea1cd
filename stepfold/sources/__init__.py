"""Readers of logs, labels and specifications, and writers of reports."""
