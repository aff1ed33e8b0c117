"""Registered queries: each operator over the driver tables, with the SQL that checks it."""

from __future__ import annotations

from . import cohort, evaluation, folders, models, series, streams, text
from .registry import QUERIES

__all__ = ["QUERIES", "cohort", "evaluation", "folders", "models", "series", "streams", "text"]
