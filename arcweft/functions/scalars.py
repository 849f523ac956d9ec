"""Scalar expressions on graph columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcweft.model import TYPES

#: Upper bounds of the affected share for each severity, and US dollars an hour by kind of node.
SEVERITIES = ((0.02, "LOW"), (0.15, "MEDIUM"), (0.40, "HIGH"))
RATES = {"GATEWAY": 50_000.0, "DATABASE": 20_000.0, "INTERNAL": 10_000.0, "EXTERNAL": 5_000.0}


def node_type_str(ordinal: Column) -> Column:
    """Name of a kind of node by its number; UNKNOWN for any other number."""
    out = F.lit("UNKNOWN")
    for i, name in reversed(list(enumerate(TYPES))):
        out = F.when(ordinal == i, name).otherwise(out)
    return out


def node_type_ordinal(name: Column) -> Column:
    """Number of a kind of node; null for an unknown name."""
    out = F.lit(None).cast("int")
    for i, known in enumerate(TYPES):
        out = F.when(name == known, i).otherwise(out)
    return out


def severity_str(fraction: Column) -> Column:
    """Severity of an affected share."""
    out = F.lit("CRITICAL")
    for bound, name in reversed(SEVERITIES):
        out = F.when(fraction < bound, name).otherwise(out)
    return out


def hourly_rate(kind: Column) -> Column:
    """Revenue at risk in an hour by kind of node."""
    out = F.lit(0.0)
    for name, rate in RATES.items():
        out = F.when(kind == name, rate).otherwise(out)
    return out
