"""Releases and support facts in shorthand: ``A1 2015-01-01`` on one system."""

from __future__ import annotations

import datetime as dt

from driftline import model

NAMES = {"A": "Alpha", "B": "Beta", "C": "Charlie", "D": "Delta"}


def key(short: str, system: str = "Windows") -> str:
    return f"{NAMES[short[0]]}_{short[1:]}_{system}_10"


def releases(spark, entries, system="Windows"):
    """``entries``: short name -> ISO date, or -> (ISO date, system)."""
    rows = []
    for short, when in entries.items():
        day, os_name = when if isinstance(when, tuple) else (when, system)
        rows.append((NAMES[short[0]], short[1:].rstrip("'"), os_name, "10", dt.date.fromisoformat(day)))
    return spark.createDataFrame(rows, model.RELEASES)


def facts(spark, support):
    """``support``: API key -> shipping releases by short name."""
    apis = spark.createDataFrame([(k,) for k in support], "interface_key string")
    pairs = [(key(short), k) for k, shorts in support.items() for short in shorts]
    return apis, spark.createDataFrame(pairs, model.JUNCTION)
