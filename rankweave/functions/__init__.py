"""Scalar helpers for score and p-value columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.operators.multilevel import query_curve
from rankweave.operators.prep import display_name, finite

__all__ = ["display_name", "finite", "log_p", "query_curve", "stripped"]


def log_p(p: Column) -> Column:
    """-log10 of a p-value, guarded against 0."""
    return -F.log10(p + F.lit(1e-300))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
