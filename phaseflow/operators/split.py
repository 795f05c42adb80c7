"""Packets to the phases of their flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_phase(packets: DataFrame, marks: DataFrame, keys: Sequence[str] = ("flow_id",), pos: str = "pos") -> DataFrame:
    """Adds ``phase``, from 1: packets up to a mark are in the phase that it ends; flows without marks are one phase."""
    found = packets.join(marks.select(*keys, "marks"), list(keys), "left")
    ended = F.size(F.filter(F.coalesce("marks", F.array().cast("array<int>")), lambda m: m < F.col(pos)))
    return found.withColumn("phase", (ended + 1).cast("int")).drop("marks")
