"""Readers and writers of logs, labelled rows, reports and sources."""
