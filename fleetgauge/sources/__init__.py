"""Readers and writers: event logs, saved History Server payloads, run history, reports."""
