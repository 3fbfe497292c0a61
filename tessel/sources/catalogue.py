"""TOML catalogues of sources."""

from __future__ import annotations

import tomllib
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fixed column names of a catalogue: required ones, and those with a default.
REQUIRED = ("doc_id", "title", "jurisdiction", "law_family", "source_type", "version_date", "effective_date", "language", "url", "preferred_format")
DEFAULTS = {"download_mode": "auto", "target_path": "", "manual_instructions": "", "source_set": "", "translation_status": ""}
SCHEMA = ", ".join(f"{c} string" for c in (*REQUIRED, *DEFAULTS))


def load(path: str | Path) -> list[dict]:
    """The sources of a catalogue; a missing required key is a KeyError."""
    with open(path, "rb") as file:
        rows = tomllib.load(file).get("sources", [])
    out = []
    for row in rows:
        one = {c: str(row[c]) for c in REQUIRED} | {c: str(row.get(c, d)) for c, d in DEFAULTS.items()}
        if one["download_mode"] not in ("auto", "manual"):
            raise ValueError(f"{one['doc_id']}: download_mode is {one['download_mode']!r}")
        out.append(one)
    return out


def catalogue(spark: SparkSession, paths: Sequence[str | Path]) -> DataFrame:
    """The sources of all catalogues; none at all, or a doc_id twice, is an error."""
    rows = [r for p in paths for r in load(p)]
    if not rows:
        raise ValueError("the catalogues hold no sources")
    if twice := sorted(d for d, n in Counter(r["doc_id"] for r in rows).items() if n > 1):
        raise ValueError(f"doc_id more than once: {', '.join(twice)}")
    return spark.createDataFrame([tuple(r[c] for c in (*REQUIRED, *DEFAULTS)) for r in rows], SCHEMA)
