"""Structured Streaming jobs and the stateful call breaker."""
