"""Failure-log triage and corpus building on Spark."""
