"""Readers and writers for text, JSON, CSV, logs, SQL dumps and directories."""
