"""Confidence is an ordered enum; a path is as sure as its weakest edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, from sure to unknown.
CONFIDENCE = ["certain", "observed", "inferred", "unresolved"]


def rank(confidence: Column) -> Column:
    """3 certain, 2 observed, 1 inferred, 0 unresolved or unknown."""
    out = F.lit(0)
    for i, name in enumerate(reversed(CONFIDENCE)):
        out = F.when(confidence == name, i).otherwise(out)
    return out


def name_of(ranked: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in reversed(CONFIDENCE))), ranked.cast("int") + 1)


def weakest(a: Column, b: Column) -> Column:
    return name_of(F.least(rank(a), rank(b)))
