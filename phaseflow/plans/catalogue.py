"""Registered queries over the driver's tables and their SQL counterparts.

The driver's tables hold no packets, so events stand in for packets and conversations for short flows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow.functions import packets as P
from phaseflow.operators import concat, features, flowmeter, label, profile, segments, sessionize, split
from phaseflow.plans import sql
from phaseflow.session import table
from phaseflow.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(sql.ORACLES)

#: Settings that exercise every rule of flow assembly on the stand-in packets.
TIMEOUT, LONGEST, SHORTEST = 86400.0, 4, 2


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.packets_from_events(table(spark, sf_dir, "events"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.flows_from_conversations(table(spark, sf_dir, "conversations"))


def _flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.flow_packets(_packets(spark, sf_dir), TIMEOUT, LONGEST, SHORTEST)


def _r(c: str) -> Column:
    return F.round(F.col(f"`{c}`").cast("double"), 6)


@query
def q_flow_key(spark, sf_dir):
    return _packets(spark, sf_dir).select("pkt_no", P.flow_key().alias("flow_key"), P.endpoint_key().alias("endpoint_key"), P.terminates().alias("is_fin"))


@query
def q_port_filter(spark, sf_dir):
    df = _packets(spark, sf_dir)
    return df.groupBy("proto").agg(F.count_if(P.with_ports()).alias("n_assembled"), F.count_if(P.with_ports() & P.tcp_or_udp()).alias("n_reassembled"), F.count_if(P.tcp_or_udp()).alias("n_profiled"))


@query
def q_sessions(spark, sf_dir):
    out = sessionize.flows(_flow_packets(spark, sf_dir))
    return out.select("flow_id", "n_packets", "n_bytes", _r("start_s").alias("start_s"), _r("duration_s").alias("duration_s"), "n_fin")


@query
def q_flow_ids(spark, sf_dir):
    df = _flow_packets(spark, sf_dir)
    other = P.rounded_flow_id(F.col("flow_key"), F.col("flow_idx"), F.col("first_ts"))
    return df.groupBy("flow_id").agg(F.min(other).alias("rounded_id"), F.min("flow_idx").alias("flow_idx"), F.min("seg").alias("seg"), F.round(F.min("first_ts"), 6).alias("first_ts"))


@query
def q_sessions_recon(spark, sf_dir):
    out = sessionize.flows(sessionize.reassembled(_packets(spark, sf_dir), TIMEOUT, LONGEST))
    return out.select("flow_id", "n_packets", "n_bytes", "n_fin", _r("duration_s").alias("duration_s"))


@query
def q_sessions_disorder(spark, sf_dir):
    """Packets whose place in the file does not follow their time: gaps below zero end no flow."""
    packets = adapters.disordered(_packets(spark, sf_dir))
    out = sessionize.flows(sessionize.flow_packets(packets, TIMEOUT, LONGEST, SHORTEST))
    return out.select("flow_id", "n_packets", "n_bytes", _r("start_s").alias("start_s"), _r("duration_s").alias("duration_s"), "n_fin")


@query
def q_super_flow_drops(spark, sf_dir):
    return sessionize.drops(_packets(spark, sf_dir), TIMEOUT, LONGEST, SHORTEST).drop("pcap")


@query
def q_direction(spark, sf_dir):
    return _flow_packets(spark, sf_dir).select("pkt_no", "flow_id", "pos", "direction")


@query
def q_iat(spark, sf_dir):
    return features.with_features(_flow_packets(spark, sf_dir)).select("pkt_no", _r("inter_arrival_time").alias("iat"))


@query
def q_up_down_rate(spark, sf_dir):
    rate = F.round(F.col("up_down_rate") * 1000, 4)
    return features.with_features(_flow_packets(spark, sf_dir)).select("pkt_no", F.when(rate == 0, 0.0).otherwise(rate).alias("rate"))  # no minus zero


@query
def q_seq_arrays(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("packet_length", F.col("length"))
    df = features.sequences(turns, ["packet_length", "direction"], ["flow_id"])
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("int").cast("string")))
    return df.select("flow_id", "n", text("packet_length").alias("lengths"), text("direction").alias("directions"))


@query
def q_matrix_umj(spark, sf_dir):
    df = segments.scored(segments.moments(_turns(spark, sf_dir), "length"))
    return df.select("flow_id", "s", "t", _r("u").alias("u"), _r("m").alias("m"), F.round(F.col("j") * 1000, 6).alias("j"))


@query
def q_fused(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    scores = {f: segments.scored(segments.moments(turns, f)) for f in ("length", "direction")}
    return segments.fused(scores, {"length": 1.0, "direction": 0.5}).withColumn("fused", F.round("fused", 9))


def _fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of values that are no whole numbers."""
    turns = _turns(spark, sf_dir).withColumns({"packet_length": F.col("length") / F.lit(7.0), "inter_arrival_time": F.col("direction") * F.lit(0.3) + F.col("pos") * F.lit(0.1)})
    return features.sequences(turns, ["packet_length", "inter_arrival_time"], ["flow_id"])


@query
def q_matrix_fraction(spark, sf_dir):
    df = segments.matrix_rows(_fractions(spark, sf_dir), "packet_length", keys=("flow_id",)).filter("s < t")
    return df.select("flow_id", "s", "t", _r("u").alias("u"), F.round(F.col("j") * 1000, 6).alias("j"))


@query
def q_fused_fraction(spark, sf_dir):
    df = segments.fused_rows(_fractions(spark, sf_dir), {"packet_length": 0.7, "inter_arrival_time": 0.3}, {"inter_arrival_time": 1e-2}, keys=("flow_id",))
    return df.withColumn("fused", F.round("fused", 6))


def _marks(spark: SparkSession, sf_dir: str, phases: list[int]) -> DataFrame:
    seq = features.sequences(_turns(spark, sf_dir).withColumn("packet_length", F.col("length")), ["packet_length", "direction"], ["flow_id"])
    return segments.divide(seq, phases, {"packet_length": 1.0, "direction": 0.5})


def _marks_of(p: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        return _marks(spark, sf_dir, [p]).select("flow_id", *[F.col("marks")[k].cast("long").alias(f"mark_{k + 1}") for k in range(p - 1)])

    run.__name__ = f"q_marks_p{p}"
    return query(run)


for _p in (2, 3, 4):
    _marks_of(_p)


@query
def q_phase_split(spark, sf_dir):
    df = split.with_phase(_turns(spark, sf_dir), _marks(spark, sf_dir, [3]))
    return df.groupBy("flow_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min("pos").alias("first_pos"))


def _meter(name: str, columns: dict[str, str]) -> None:
    def run(spark, sf_dir):
        df = flowmeter.statistics(_flow_packets(spark, sf_dir), ["flow_id"])
        return df.select("flow_id", *[(F.col(f"`{c}`") if dict(df.dtypes)[c] == "string" else F.round(F.col(f"`{c}`").cast("double"), sql.digits(c))).alias(a) for c, a in columns.items()])

    run.__name__ = f"q_flowmeter_{name}"
    query(run)


for _name, _columns in sql.METER.items():
    _meter(_name, _columns)


@query
def q_flowmeter_headers(spark, sf_dir):
    df = flowmeter.statistics(adapters.with_headers(_flow_packets(spark, sf_dir)), ["flow_id"])
    names = {"header": "{} Header Length", "seg_min": "{} Seg Size Min", "data": "{} Act Data Pkts", "len": "Total Length of {} Packet", "max": "{} Packet Length Max"}
    cols = [F.col(f"`{n.format(s)}`").alias(f"{s.lower()}_{a}") for s in ("Fwd", "Bwd") for a, n in names.items()]
    return df.select("flow_id", *cols, F.col("FWD Init Win Bytes").alias("fwd_window"), F.col("Bwd Init Win Bytes").alias("bwd_window"))


@query
def q_flowmeter_segments(spark, sf_dir):
    df = flowmeter.statistics(_flow_packets(spark, sf_dir), ["flow_id"], timeout=3600.0)
    n = F.col("Total Fwd Packet") + F.col("Total Bwd packets")
    return df.select("flow_id", "meter_no", n.alias("n"), F.round("Flow Duration", -3).alias("duration"), F.col("Src IP").alias("src_ip"))


def _phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four phases: events of a user's first 28 days, a phase a week of the day of the year."""
    ev = table(spark, sf_dir, "events")
    us = adapters.epoch_us(ev, "ts")
    day = F.floor(us / 86400000000)
    stamp = F.date_format(F.timestamp_micros(us), flowmeter.TIME_FORMAT)
    return ev.select(
        F.lit("ev").alias("basename"),
        (F.floor(day / 7) % 4 + 1).cast("int").alias("phase"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("Src IP"),
        F.lit("10.1.1.1").alias("Dst IP"),
        (F.col("user_id") % 7 + 1000).cast("int").alias("Src Port"),
        F.lit(80).alias("Dst Port"),
        F.lit(6).alias("Protocol"),
        stamp.alias("Timestamp"),
        F.col("event_id").alias("row_no"),
        F.round("value", 2).alias("Flow Duration"),
        F.floor("value").cast("double").alias("Total Fwd Packet"),
        F.floor(F.col("value") * 2).cast("double").alias("Fwd Packet Length Max"),
        F.floor(F.col("value") / 2).cast("double").alias("Active Min"),
        F.floor(F.col("value") * 3).cast("double").alias("Down/Up Ratio"),
    )


CONCAT = ("Flow Duration", "Total Fwd Packet", "Fwd Packet Length Max", "Active Min", "Down/Up Ratio")
GAP = 30 * 86400.0
#: So short that phases without rows that count are common, and carried forward.
CARRY_GAP = 2 * 86400.0


@query
def q_concat_takewhile(spark, sf_dir):
    df = concat.accepted(_phase_rows(spark, sf_dir), [1, 2, 3, 4], GAP)
    return df.select(F.col("row_no").alias("event_id"), "phase", F.col("rn").cast("long").alias("rn"))


@query
def q_concat_agg(spark, sf_dir):
    df = concat.wide(_phase_rows(spark, sf_dir), CONCAT, [1, 2], GAP)
    return df.select(F.col("Flow Key").alias("flow_key"), F.col("Timestamp").alias("ts"), *[_r(f"{f}_p{p}").alias(f"f{i}_p{p}") for i, f in enumerate(CONCAT) for p in (1, 2)])


@query
def q_concat_carry(spark, sf_dir):
    df = concat.wide(_phase_rows(spark, sf_dir), CONCAT[1:2], [1, 2, 3, 4], CARRY_GAP)
    return df.select(F.col("Flow Key").alias("flow_key"), *[_r(f"Total Fwd Packet_p{p}").alias(f"p{p}") for p in (1, 2, 3, 4)])


def _labelled(spark: SparkSession, sf_dir: str, rules: list[dict], bad_every: int = 0, **options) -> DataFrame:
    """Orders as flows; every ``bad_every``-th has an unreadable time stamp."""
    o = table(spark, sf_dir, "orders")
    stamp = F.date_format(F.timestamp_micros(adapters.epoch_us(o, "o_orderdate")), flowmeter.TIME_FORMAT)
    if bad_every:
        stamp = F.when(F.col("o_orderkey") % bad_every == 0, F.lit("n/a")).otherwise(stamp)
    status = F.when(F.col("o_orderstatus") == "F", "10.0.0.1").when(F.col("o_orderstatus") == "O", "10.0.0.2").otherwise("10.0.0.3")
    port = F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 5 + 80)
    df = o.select(
        F.col("o_orderkey").alias("Flow ID"),
        F.concat_ws("-", status, F.lit("10.9.9.9"), F.lit("5000"), (F.col("o_custkey") % 5 + 80).cast("string"), F.lit("6")).alias("Flow Key"),
        stamp.alias("Timestamp"),
        F.floor(F.col("o_totalprice") * 1000).cast("double").alias("Flow Duration_p1"),
        (F.col("o_orderkey") % 3).cast("double").alias("Total Length of Fwd Packet_p1"),
        (F.col("o_orderkey") % 4).cast("double").alias("Total Length of Bwd Packet_p1"),
        (F.col("o_orderkey") % 2).cast("double").alias("RST Flag Count_p1"),
        (F.col("o_orderkey") % 17).cast("double").alias("Total Fwd Packet_p1"),
        port.cast("int").alias("maybe_port"),
        F.col("o_orderpriority").alias("priority"),
    )
    df = label.with_endpoints(df)
    return label.labelled(df, {"meta": {"default_label": "BENIGN"}, "rules": rules}, **options).select(F.col("Flow ID").alias("o_orderkey"), F.col("Label").alias("label"))


def _c(field: str, op: str, value) -> dict:
    return {"field": field, "op": op, "value": value}


ORDER = [
    {"label": "B", "priority": 20, "match": [_c("dst_port", "in", [81, 82, 83])]},
    {"label": "A", "priority": 10, "match": [_c("src_ip", "==", "10.0.0.1")]},
    {"label": "C", "priority": 30, "match": [_c("dst_port", "==", 82), _c("zero_fwd", "==", True)]},
    {"label": "Z", "match": [_c("any_ip", "in", ["10.0.0.3"]), _c("total_fwd_pkts", ">", 12)]},
]
OPS = [
    {"label": "ne", "priority": 1, "match": [_c("maybe_port", "!=", 80), _c("priority", "regex", "[12]")]},
    {"label": "notin", "priority": 2, "match": [_c("maybe_port", "not_in", [80, 81, 82]), _c("fwd_rst_flags", ">=", 1)]},
    {"label": "null", "priority": 3, "match": [_c("maybe_port", "isnull", True), _c("total_fwd_pkts", "<=", 3)]},
    {"label": "text", "priority": 4, "match": [_c("priority", "contains", "LOW"), _c("maybe_port", "notnull", True), _c("proto", "in", [6, "TCP"])]},
    {"label": "lt", "priority": 5, "match": [_c("flow_duration_s", "<", 40.0), _c("any", "==", True)]},
]
WINDOW = ["1994-03-01T00:00:00", "1995-02-28T12:00:00"]
TIMES = [
    {"label": "one", "priority": 1, "match": [_c("time_start", "==", WINDOW[0]), _c("time_end", "==", WINDOW[1])]},
    {"label": "two", "priority": 2, "match": [_c("time_window", "ranges", [["1996-01-01T00:00:00", "1996-06-30T00:00:00"], ["1997-01-01T00:00:00", "1997-02-01T00:00:00"]]), _c("src_ip", "==", "10.0.0.2")]},
    {"label": "three", "priority": 3, "match": [_c("time_window", "range", ["1993-01-01T00:00:00", "1993-03-01T00:00:00"])]},
]
NESTED = [
    {"label": "nest", "priority": 1, "match": [_c("src_ip", "==", "10.0.0.1")], "extra_logic": {"any_of": [_c("dst_port", "==", 80), {"all_of": [_c("total_fwd_pkts", ">", 5), _c("bwd_rst_flags", "==", 1)]}]}},
    {"label": "both", "priority": 2, "match": [], "extra_logic": {"all_of": [_c("dst_port", "==", 84), _c("zero_fwd", "==", True)]}},
]


#: Fields that stand for statistics of the first phase.
FIELDS = [
    {"label": "short", "priority": 1, "match": [_c("flow_duration", "<", 60.0)]},
    {"label": "silent", "priority": 2, "match": [_c("zero_bwd", "==", True), _c("total_fwd_len", ">=", 1)]},
    {"label": "large", "priority": 3, "match": [_c("total_bwd_len", "==", 3), _c("zero_bwd", "==", False), _c("flow_duration", ">=", 100.0)]},
]


@query
def q_label_fields(spark, sf_dir):
    return _labelled(spark, sf_dir, FIELDS)


@query
def q_label_zone(spark, sf_dir):
    """Rule times in UTC, stamps in a zone with summer time."""
    return _labelled(spark, sf_dir, TIMES, zone="America/Halifax")


@query
def q_label_order(spark, sf_dir):
    return _labelled(spark, sf_dir, ORDER)


@query
def q_label_first(spark, sf_dir):
    return _labelled(spark, sf_dir, ORDER, policy="first")


@query
def q_label_ops(spark, sf_dir):
    return _labelled(spark, sf_dir, OPS)


@query
def q_label_time(spark, sf_dir):
    return _labelled(spark, sf_dir, TIMES)


@query
def q_label_nested(spark, sf_dir):
    return _labelled(spark, sf_dir, NESTED)


@query
def q_label_null_ts(spark, sf_dir):
    return _labelled(spark, sf_dir, TIMES, bad_every=13)


@query
def q_label_strict_ts(spark, sf_dir):
    return _labelled(spark, sf_dir, TIMES, bad_every=13, strict_time=True)


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("Tot Fwd Pkts"), F.count_if(F.col("l_returnflag") == "A").alias("Tot Bwd Pkts"))
    return profile.totals(n)


@query
def q_dist_stats(spark, sf_dir):
    df = profile.statistics(_per_order(spark, sf_dir), above=(2, 4))
    return df.select("n", _r("mean").alias("mean"), _r("median").alias("median"), _r("std").alias("std"), "least", "most", _r("pct_above_2").alias("pct_above_2"), _r("pct_above_4").alias("pct_above_4"))


@query
def q_dist_quantiles(spark, sf_dir):
    return profile.quantiles(_per_order(spark, sf_dir)).select(F.col("q").cast("double").alias("q"), _r("value").alias("value"))


@query
def q_dist_hist(spark, sf_dir):
    return profile.histogram(_per_order(spark, sf_dir)).select("bin", "n", _r("low").alias("low"), _r("high").alias("high"))


@query
def q_flow_counts_fin(spark, sf_dir):
    return profile.flow_sizes(_packets(spark, sf_dir), idle=30 * 86400.0)
