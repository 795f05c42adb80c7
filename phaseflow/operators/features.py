"""Per-packet feature sequences of assembled flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FEATURES = ("packet_length", "inter_arrival_time", "direction", "up_down_rate")
#: Another name under which the rate may be asked for.
ALIASES = {"up_down_ratio": "up_down_rate"}


def in_flow() -> WindowSpec:
    return Window.partitionBy("pcap", "flow_key", "seg").orderBy("pkt_no")


def checked(names: Sequence[str]) -> list[str]:
    """``names`` without aliases; raises for a name that is no feature."""
    names = [ALIASES.get(n, n) for n in names]
    if unknown := sorted(set(names) - set(FEATURES)):
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return names


def with_features(assembled: DataFrame) -> DataFrame:
    """Adds packet_length, inter_arrival_time and up_down_rate to the packets of flows.

    The gap is 0 for the first packet and may be negative; the rate is length over gap with the sign of the direction,
    0 for the first packet and null where the gap cancels the smoothing term.
    """
    iat = F.coalesce(F.col("ts_s") - F.lag("ts_s").over(in_flow()), F.lit(0.0))
    df = assembled.withColumn("packet_length", F.col("length").cast("double")).withColumn("inter_arrival_time", iat)
    rate = F.try_divide(F.col("packet_length"), F.col("inter_arrival_time") + 1e-6) * F.col("direction")
    return df.withColumn("up_down_rate", F.when(F.col("pos") == 1, 0.0).otherwise(rate))


def sequences(featured: DataFrame, names: Sequence[str] = FEATURES, keys: Sequence[str] = ("pcap", "flow_id"), order: str = "pos") -> DataFrame:
    """One row a flow: ``n`` and an array a feature, in packet order."""
    names = checked(names)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(n).cast("double").alias(n) for n in names])))
    df = featured.groupBy(*keys).agg(rows.alias("__rows"))
    return df.select(*keys, F.size("__rows").alias("n"), *[F.col(f"__rows.{n}").alias(n) for n in names])
