"""Structured streaming over the event log and arriving files."""
