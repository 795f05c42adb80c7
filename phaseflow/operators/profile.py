"""Distributions of packets a flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseflow.functions import packets as P

#: Levels of the report.
QUANTILES = (0.05, *(k / 10 for k in range(1, 9)), *(k / 100 for k in range(90, 100)))


def totals(flows: DataFrame, forward: str = "Tot Fwd Pkts", backward: str = "Tot Bwd Pkts") -> DataFrame:
    """``total`` packets of each flow, flows without any left out."""
    return flows.withColumn("total", F.col(f"`{forward}`") + F.col(f"`{backward}`")).filter(F.col("total") > 0)


def statistics(df: DataFrame, value: str = "total", above: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Count, mean, median, deviation, extremes and the percentage of values above each limit; null without values."""
    x = F.col(value)
    shares = [F.try_divide(F.count_if(x > k) * 100.0, F.count(x)).alias(f"pct_above_{k}") for k in above]
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), *shares)


def quantiles(df: DataFrame, value: str = "total", at: Sequence[float] = QUANTILES) -> DataFrame:
    """(q, value): exact quantiles, linear between neighbours."""
    one = df.agg(F.percentile(value, list(at)).alias("v"))
    return one.select(F.posexplode("v").alias("i", "value")).select(F.array(*[F.lit(q) for q in at])[F.col("i")].alias("q"), "value")


def histogram(df: DataFrame, value: str = "total", bins: int = 50) -> DataFrame:
    """(bin, low, high, n) over equal bins from least to most, empty ones too; the last one is closed.

    If all values are the same the bins reach half a unit to both sides; without values there are none.
    """
    same = F.max(value) == F.min(value)
    edge = lambda f, by: (f(value) + F.when(same, by).otherwise(0)).cast("double")
    span = df.agg(edge(F.min, -0.5).alias("lo"), edge(F.max, 0.5).alias("hi")).filter(F.col("lo").isNotNull())
    span = span.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((F.col(value).cast("double") - F.col("lo")) / F.col("width")) + 1, F.lit(bins))
    counted = df.join(F.broadcast(span)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # one row
    every = span.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "width")
    low = F.col("lo") + (F.col("bin") - 1) * F.col("width")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), low.alias("low"), (F.col("lo") + F.col("bin") * F.col("width")).alias("high"))


def report(df: DataFrame, value: str = "total", above: Sequence[int] = (100,)) -> str:
    """The statistics and quantiles as text."""
    s = statistics(df, value, above).first()
    lines = ["Packets a flow", f"- flows: {s.n}"]
    if s.n:
        lines += [f"- most: {s.most}", f"- least: {s.least}", f"- mean: {s['mean']:.2f}", f"- median: {s['median']:g}", f"- standard deviation: {s['std'] or 0:.2f}"]
        lines += [f"- quantile {r.q:.2f}: {r.value:g}" for r in quantiles(df, value).orderBy(F.desc("q")).collect()]  # one row a level
        lines += [f"- more than {k}: {s[f'pct_above_{k}']:.2f} %" for k in above]
    return "\n".join(lines) + "\n"


def flow_sizes(packets: DataFrame, idle: float = 120.0) -> DataFrame:
    """(endpoint_key, part, n): packets of TCP and UDP flows, parted after FIN and RST.

    A part that nothing ends counts only if it lasts at most ``idle`` seconds. Parts follow the order of packets.
    """
    df = packets.filter(P.tcp_or_udp()).withColumn("endpoint_key", P.endpoint_key()).withColumn("is_fin", P.terminates())
    w = Window.partitionBy("pcap", "endpoint_key").orderBy("pkt_no")
    ended = F.coalesce(F.lag("is_fin").over(w), F.lit(False)).cast("int")
    df = df.withColumn("part", F.sum(ended).over(w).cast("int"))
    out = df.groupBy("pcap", "endpoint_key", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("is_fin").alias("ended"),
        (F.max_by("ts_s", "pkt_no") - F.min_by("ts_s", "pkt_no")).alias("lasted"),
    )
    return out.filter(F.col("ended") | (F.col("lasted") <= idle)).drop("pcap", "lasted")
