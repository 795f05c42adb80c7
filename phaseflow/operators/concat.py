"""Flow rows of several phases to one wide row a flow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDS = ("Src IP", "Dst IP", "Src Port", "Dst Port", "Protocol")
TIME_FORMAT = "dd/MM/yyyy hh:mm:ss a"


def aggregate_for(name: str) -> str:
    """How rows of one phase are joined; the first part of the name that is found decides, as written."""
    for parts, how in ((("Total", "Count", "Length"), "sum"), (("Max", "Duration"), "max"), (("Min",), "min")):
        if any(p in name for p in parts):
            return how
    return "mean"


def _joined(name: str) -> Column:
    """The aggregate over accepted rows; NaN if any of them is missing."""
    x = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))
    how = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[aggregate_for(name)](x)
    return F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(how).alias(name)


def accepted(rows: DataFrame, phases: Sequence[int], timeout: float = 600.0, keys: Sequence[str] = ("basename", *IDS), stamp: str = "Timestamp", order: str = "string", tie: str = "row_no") -> DataFrame:
    """Rows that count for their key and phase, with ``rn``, their place.

    Keys without a row of the first phase are dropped. Rows of a phase go by time stamp, as text unless ``order`` is
    ``time``. All rows of the first phase count; a row of a later phase counts while its time is less than ``timeout``
    seconds after the row before it, or for the first after the last one that counted in the phases before; the first
    that is not ends its phase.
    """
    at = F.unix_timestamp(F.to_timestamp(F.col(stamp), TIME_FORMAT)).cast("double")
    by = F.col(stamp) if order == "string" else at
    whole = Window.partitionBy(*keys)
    in_phase = Window.partitionBy(*keys, "phase").orderBy(by, F.col(tie))
    df = rows.filter(F.col("phase").isin(list(phases))).withColumn("at", at).withColumn("rn", F.row_number().over(in_phase))
    df = df.withColumn("stamp_min", F.min(stamp).over(whole)).withColumn("has_first", F.max(F.col("phase") == phases[0]).over(whole)).filter("has_first").drop("has_first")
    # last time that counted before a phase: the phases are few, so their chain is written out as window sums
    df = df.withColumn("ok", F.col("phase") == phases[0])
    last = F.max(F.when(F.col("ok"), F.struct("rn", "at"))).over(whole)["at"]
    df = df.withColumn("last", last)
    for p in phases[1:]:
        here = F.col("phase") == p
        step = F.col("at") - F.coalesce(F.lag("at").over(in_phase), F.col("last"))
        run = F.min((step < timeout).cast("int")).over(in_phase.rowsBetween(Window.unboundedPreceding, 0)) == 1
        df = df.withColumn("ok", F.when(here, run).otherwise(F.col("ok")))
        newest = F.max(F.when(here & F.col("ok"), F.struct("rn", "at"))).over(whole)["at"]
        df = df.withColumn("last", F.coalesce(newest, F.col("last")))
    return df.filter("ok").drop("ok", "last")


def wide(rows: DataFrame, features: Sequence[str], phases: Sequence[int], timeout: float = 600.0, basename: str = "basename", stamp: str = "Timestamp", order: str = "string", tie: str = "row_no") -> DataFrame:
    """One row a key: ``basename``, ``Flow Key``, ``Timestamp`` and ``<feature>_p<k>``.

    A phase in which nothing counts repeats the phase before it. The time stamp is the least, as text, of all rows of
    the key, whether they count or not.
    """
    keys = (basename, *IDS)
    df = accepted(rows, phases, timeout, keys, stamp, order, tie)
    per_phase = df.groupBy(*keys, "phase").agg(F.min("stamp_min").alias("stamp_min"), F.struct(*[_joined(f) for f in features]).alias("v"))
    picks = [F.max_by(F.when(F.col("phase") == p, F.col("v")), F.when(F.col("phase") == p, F.lit(1))).alias(f"v{p}") for p in phases]
    one = per_phase.groupBy(*keys).agg(F.min("stamp_min").alias(stamp), *picks)
    carried = {p: reduce(lambda a, b: F.coalesce(b, a), [F.col(f"v{q}") for q in phases[: k + 1]]) for k, p in enumerate(phases)}
    cols = [carried[p][f].alias(f"{f}_p{p}") for p in phases for f in features]
    return one.select(basename, F.concat_ws("-", *[F.col(f"`{c}`") for c in IDS]).alias("Flow Key"), stamp, *cols)
