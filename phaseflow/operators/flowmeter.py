"""Statistics of flows, a row each, as one aggregation.

Definitions follow the published feature lists of bidirectional flow meters. Lengths are payloads where packets carry
their length, or else whole frames; times and gaps are microseconds; rates are per second and null for flows that last no time; deviations are those of samples, null for
one value. Forward is the direction of the first packet. Gaps above ``IDLE_S`` part active stretches, gaps above
``SUBFLOW_S`` part subflows, and a bulk is ``BULK`` or more packets of one direction in a row with gaps up to
``SUBFLOW_S``. Header, window and payload columns need packets that carry them (``header_length``, ``window``,
``payload_length``) and are left out otherwise. With ``timeout`` a gap above it ends a row and begins another, as a meter
that sees a phase's packets alone would do; ``meter_no`` then counts the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseflow.functions import packets as P

IDLE_S, SUBFLOW_S, BULK = 5.0, 1.0, 4
FLAGS = {"FIN": P.FIN, "SYN": P.SYN, "RST": P.RST, "PSH": P.PSH, "ACK": P.ACK, "URG": P.URG, "CWR": P.CWR, "ECE": P.ECE}
TIME_FORMAT = "dd/MM/yyyy hh:mm:ss a"


def _prepared(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("pkt_no")
    first = lambda c: F.first(c).over(w)
    df = packets.withColumn("fwd", (F.col("src_ip") == first("src_ip")) & (F.col("src_port") == first("src_port")))
    own = Window.partitionBy(*keys, "fwd").orderBy("pkt_no")
    df = df.withColumn("gap_s", F.col("ts_s") - F.lag("ts_s").over(w)).withColumn("own_gap_s", F.col("ts_s") - F.lag("ts_s").over(own))
    cut = lambda limit: F.sum((F.coalesce(F.col("gap_s") > limit, F.lit(False))).cast("int")).over(w)
    turn = F.coalesce((F.lag("fwd").over(w) != F.col("fwd")) | (F.col("gap_s") > SUBFLOW_S), F.lit(False))
    df = df.withColumn("active_no", cut(IDLE_S)).withColumn("subflow_no", cut(SUBFLOW_S)).withColumn("run_no", F.sum(turn.cast("int")).over(w))
    run = Window.partitionBy(*keys, "run_no")
    df = df.withColumn("run_n", F.count(F.lit(1)).over(run)).withColumn("run_at", F.row_number().over(run.orderBy("pkt_no")))
    stretch = Window.partitionBy(*keys, "active_no")
    return df.withColumn("active_us", F.when(F.row_number().over(stretch.orderBy("pkt_no")) == 1, (F.max("ts_s").over(stretch) - F.min("ts_s").over(stretch)) * 1e6))


def _four(x: Column, name: str) -> list[Column]:
    return [F.avg(x).alias(f"{name} Mean"), F.stddev_samp(x).alias(f"{name} Std"), F.max(x).alias(f"{name} Max"), F.min(x).alias(f"{name} Min")]


def _headers(columns: Sequence[str], only: dict[str, Column]) -> list[Column]:
    """What needs columns that not all packets have."""
    out = []
    for side, is_side in only.items():
        first = lambda c, is_side=is_side: F.coalesce(F.min_by(F.when(is_side, F.col(c)), F.when(is_side & F.col(c).isNotNull(), F.col("pkt_no"))), F.lit(0)).cast("double")
        if "header_length" in columns:
            header = F.when(is_side, F.col("header_length").cast("double"))
            out += [F.coalesce(F.sum(header), F.lit(0.0)).alias(f"{side} Header Length"), F.coalesce(F.min(header), F.lit(0.0)).alias(f"{side} Seg Size Min")]
        if "window" in columns:
            out.append(first("window").alias({"Fwd": "FWD Init Win Bytes", "Bwd": "Bwd Init Win Bytes"}[side]))
        if "payload_length" in columns:
            out.append(F.count_if(is_side & (F.col("payload_length") > 0)).cast("double").alias(f"{side} Act Data Pkts"))
    return out


def statistics(packets: DataFrame, keys: Sequence[str] = ("pcap", "phase", "flow_id"), timeout: float | None = None) -> DataFrame:
    """One row for each of ``keys``; columns carry the names that concatenation and labelling read."""
    if timeout is not None:
        gap = F.col("ts_s") - F.lag("ts_s").over(Window.partitionBy(*keys).orderBy("pkt_no"))
        packets = packets.withColumn("__late", F.coalesce(gap > timeout, F.lit(False)).cast("int"))
        packets = packets.withColumn("meter_no", F.sum("__late").over(Window.partitionBy(*keys).orderBy("pkt_no"))).drop("__late")
        keys = (*keys, "meter_no")
    df = _prepared(packets, keys)
    length, fwd = F.col("payload_length" if "payload_length" in packets.columns else "length").cast("double"), F.col("fwd")
    only = {"Fwd": fwd, "Bwd": ~fwd}
    first = lambda c, t=None: F.min_by(c, "pkt_no").cast(t or dict(packets.dtypes)[c])
    span = (F.max("ts_s") - F.min("ts_s")) * 1e6
    out = [first("src_ip").alias("Src IP"), first("src_port").alias("Src Port"), first("dst_ip").alias("Dst IP"), first("dst_port").alias("Dst Port"), first("proto").alias("Protocol")]
    out += [F.min("ts_s").alias("start_s"), span.alias("Flow Duration"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(length).alias("bytes")]
    for side, is_side in only.items():
        x = F.when(is_side, length)
        out += [F.count(x).cast("double").alias({"Fwd": "Total Fwd Packet", "Bwd": "Total Bwd packets"}[side]), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"Total Length of {side} Packet")]
        out += _four(x, f"{side} Packet Length")
        gap = F.when(is_side, F.col("own_gap_s") * 1e6)
        out += [F.coalesce(F.sum(gap), F.lit(0.0)).alias(f"{side} IAT Total"), *_four(gap, f"{side} IAT")]
        for flag in ("PSH", "URG"):
            out.append(F.count_if(is_side & P.has_flag(FLAGS[flag])).cast("double").alias(f"{side} {flag} Flags"))
        bulk = is_side & (F.col("run_n") >= BULK)
        out += [F.count_if(bulk & (F.col("run_at") == 1)).cast("double").alias(f"{side} bulks"), F.count_if(bulk).cast("double").alias(f"{side} bulk packets"), F.coalesce(F.sum(F.when(bulk, length)), F.lit(0.0)).alias(f"{side} bulk bytes")]
        out.append(F.coalesce(F.sum(F.when(bulk & (F.col("run_at") > 1), F.col("gap_s"))), F.lit(0.0)).alias(f"{side} bulk s"))
    out += _headers(packets.columns, only)
    out += [*_four(length, "Packet Length"), F.var_samp(length).alias("Packet Length Variance"), *_four(F.col("gap_s") * 1e6, "Flow IAT")]
    out += [F.count_if(P.has_flag(bit)).cast("double").alias(f"{name} Flag Count") for name, bit in FLAGS.items()]
    out += [(F.max("subflow_no") + 1).cast("double").alias("subflows")]
    out += [*_four(F.col("active_us"), "Active"), *_four(F.when(F.col("gap_s") > IDLE_S, F.col("gap_s") * 1e6), "Idle")]
    df = df.groupBy(*keys).agg(*out)
    seconds = F.col("Flow Duration") / 1e6
    per = lambda c: F.try_divide(F.col(c), F.when(seconds != 0, seconds))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    df = df.withColumns({"Flow Bytes/s": per("bytes"), "Flow Packets/s": per("n"), "Fwd Packets/s": per("Total Fwd Packet"), "Bwd Packets/s": per("Total Bwd packets")})
    df = df.withColumns({"Down/Up Ratio": ratio("Total Bwd packets", "Total Fwd Packet"), "Average Packet Size": F.col("bytes") / F.col("n")})
    for side, total in (("Fwd", "Total Fwd Packet"), ("Bwd", "Total Bwd packets")):
        size = f"Total Length of {side} Packet"
        df = df.withColumns({
            f"{side} Segment Size Avg": ratio(size, total),
            f"Subflow {side} Packets": F.col(total) / F.col("subflows"),
            f"Subflow {side} Bytes": F.col(size) / F.col("subflows"),
            f"{side} Bytes/Bulk Avg": ratio(f"{side} bulk bytes", f"{side} bulks"),
            f"{side} Packet/Bulk Avg": ratio(f"{side} bulk packets", f"{side} bulks"),
            f"{side} Bulk Rate Avg": F.coalesce(F.try_divide(F.col(f"{side} bulk bytes"), F.when(F.col(f"{side} bulk s") != 0, F.col(f"{side} bulk s"))), F.lit(0.0)),
        })
        df = df.drop(f"{side} bulks", f"{side} bulk packets", f"{side} bulk bytes", f"{side} bulk s")
    stamp = F.date_format(F.timestamp_micros(F.floor(F.col("start_s") * 1e6).cast("long")), TIME_FORMAT)
    return df.withColumn("Timestamp", stamp).drop("n", "bytes", "subflows", "start_s")
