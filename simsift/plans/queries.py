"""All registered queries, grouped by module."""

from . import classification, corpus, evaluation, inputs_outputs, streams  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
