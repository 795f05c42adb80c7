"""Large buckets dealt to bounded cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseflow.llm.scratch import written


def dealt(rows: DataFrame, keys: Sequence[str], item: Column, shard: int, tag: str) -> DataFrame:
    """``rows`` with ``i``, ``j`` and ``shard``: the cells (keys, i, j) in which every pair of a bucket meets once.

    A bucket of more than ``shard`` rows is dealt to shards by a hash of ``item``; a row of shard s goes to the cells
    (s, j), j >= s, and (i, s), i < s. In cell (i, j) the rows of shard i meet those of shard j. No cell holds more than
    about twice ``shard`` rows, whatever share of all rows has one key.
    """
    large = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard), f"{tag}-large")
    parts = F.coalesce(F.ceil(F.col("n") / shard), F.lit(1)).cast("int")
    dealt_to = rows.join(large, list(keys), "left").select(*rows.columns, parts.alias("parts"))
    dealt_to = dealt_to.withColumn("shard", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("shard")).alias("i"), F.greatest(x, F.col("shard")).alias("j")))
    out = dealt_to.select(*rows.columns, "shard", F.explode(cells).alias("c"))
    return out.select(*rows.columns, "shard", "c.i", "c.j")


#: Rows that a task takes at a time, if whole cells allow it.
TAKEN = 1 << 16


def whole_cells(batches: Iterator[pa.RecordBatch], keys: Sequence[str], taken: int = TAKEN) -> Iterator[pa.Table]:
    """Whole runs of equal ``keys``, some at a time, of rows that are sorted by them: a task holds about ``taken`` rows or
    one cell, however many rows its partition has."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < taken:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(n, bool)
        for k in keys:
            value = t.column(k).to_numpy()
            other |= value != value[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut).combine_chunks().to_batches()
        n -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def gathered(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with the rows of a cell in one partition, one after the other."""
    return cells.repartition(*keys).sortWithinPartitions(*keys)
