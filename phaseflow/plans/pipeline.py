"""Captures to labelled, phased flow tables.

Each stage is a table by capture: packets of assembled flows, marks for each number of phases, meter rows, wide rows and
labels for each number. A stage reads the table before it, so captures are scanned and flows assembled once however many
numbers of phases there are, and the search runs once for all of them. Captures that a stage has done are not done again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow.config import Config
from phaseflow.operators import concat, features, flowmeter, label, segments, sessionize, split
from phaseflow.sources import tables

#: Statistics that name a flow rather than describe it.
NOT_FEATURES = ("pcap", "phase", "flow_id", "meter_no", "basename", "row_no", "Timestamp", *concat.IDS)
FLOW = ("pcap", "flow_id")


def assembled(packets: DataFrame, config: Config) -> DataFrame:
    return sessionize.flow_packets(packets, config.timeout_sec, config.max_flow_length, config.min_flow_length)


def marked(flows: DataFrame, config: Config, phases: Sequence[int]) -> DataFrame:
    """Marks of each flow for all numbers of phases at once."""
    names = features.checked(config.feature_types)
    seq = features.sequences(features.with_features(flows), names)
    weights = {n: config.weights.get(n, 1.0) for n in names}
    return segments.divide(seq, phases, weights, config.lambda_dict, config.regularization_lambda, config.max_flow_length, FLOW)


def phased(packets: DataFrame, config: Config) -> dict[int, DataFrame]:
    """Packets with their phase, for each number of phases, as frames that nothing is kept for."""
    flows = assembled(packets, config)
    marks = marked(flows, config, config.num_phases)
    return {p: split.with_phase(flows, marks.filter(F.col("num_phases") == p), FLOW) for p in config.num_phases}


def metered(packets: DataFrame, config: Config) -> DataFrame:
    """Statistics of each flow and phase, cut where the meter's own timeout runs out."""
    stats = flowmeter.statistics(packets, timeout=config.meter_timeout_sec).withColumn("basename", F.col("pcap"))
    return stats.withColumn("row_no", F.concat_ws("-", "flow_id", F.lpad(F.col("meter_no").cast("string"), 6, "0")))


def wide_table(stats: DataFrame, phases: int, config: Config) -> DataFrame:
    """One row a flow, statistics of each phase side by side."""
    named = [c for c in stats.columns if c not in NOT_FEATURES and c not in config.concat_mask]
    return concat.wide(stats, named, list(range(1, phases + 1)), config.concat_timeout_sec)


def labelled_table(wide: DataFrame, rules: dict[str, Any], config: Config) -> DataFrame:
    flows = label.with_endpoints(wide, config.label_mask, time_format=config.time_format)
    return label.labelled(flows, rules, shift=timedelta(seconds=config.rule_shift_sec), zone=config.rule_zone or None)


def run(spark: SparkSession, packets: DataFrame, config: Config, again: bool = False, captures: Sequence[str] | None = None) -> dict[int, str]:
    """Writes all stage tables below the output folder and returns the paths of the labelled ones, by number of phases.

    ``captures`` names the captures of ``packets`` (they are looked up if it does not).
    """
    rules = label.load_rules(config.rules_path) if config.rules_path else {}
    if captures is None:
        captures = [r.pcap for r in packets.select("pcap").distinct().collect()]  # a row a capture
    stages = tables.Stages(spark, config.output_dir, captures, again)
    of = lambda df, some: df.filter(F.col("pcap").isin(some))
    flows = stages.table("packets", lambda some: assembled(of(packets, some), config))
    missing = [p for p in config.num_phases if set(captures) - stages.done(f"marks_{p}")]
    searched: dict[str, DataFrame] = {}

    def marks_of(p: int, some: list[str]) -> DataFrame:
        if "marks" not in searched:  # one search for all that miss any
            path = f"{stages.folder}/_marks"
            every = sorted(set().union(*(set(captures) - stages.done(f"marks_{q}") for q in missing)))
            marked(of(flows, every), config, missing).write.mode("overwrite").parquet(path)
            searched["marks"] = spark.read.parquet(path)
        return of(searched["marks"].filter(F.col("num_phases") == p), some).select("flow_id", "num_phases", "marks", "pcap")

    out = {}
    for p in config.num_phases:
        marks = stages.table(f"marks_{p}", lambda some, p=p: marks_of(p, some))
        meter = stages.table(f"meter_{p}", lambda some, marks=marks: metered(split.with_phase(of(flows, some), of(marks, some), FLOW), config))
        wide = stages.table(f"wide_{p}", lambda some, p=p, meter=meter: wide_table(of(meter, some), p, config).withColumn("pcap", F.col("basename")))
        stages.table(f"labeled_{p}", lambda some, wide=wide: labelled_table(of(wide, some), rules, config))
        out[p] = f"{stages.folder}/labeled_{p}"
    return out
