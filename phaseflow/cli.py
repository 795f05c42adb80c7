"""Command line: ``spark-submit phaseflow/cli.py <command> ...``, a command a stage and one for all of them.

Stage tables are Parquet; ``concat`` and ``label`` also read and write CSV files by capture.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow import config as settings
from phaseflow.functions.udfs import register
from phaseflow.operators import concat, features, label, profile, segments, sessionize, split
from phaseflow.plans import pipeline
from phaseflow.session import reachable
from phaseflow.sources import pcap, tables

COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace, settings.Config], None]] = {}


def command(f: Callable[[SparkSession, argparse.Namespace, settings.Config], None]) -> Callable:
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


def _write(df: DataFrame, args: argparse.Namespace) -> None:
    df.write.mode("overwrite").parquet(args.output)


@command
def run(spark, args, conf):
    """captures to labelled tables, all stages"""
    conf = replace(conf, **{k: v for k, v in (("input_dir", args.input), ("output_dir", args.output)) if v})
    names = [r.path.rpartition("/")[2] for r in pcap.captures(spark, conf.input_dir).select("path").collect()]  # a row a capture
    pipeline.run(spark, pcap.read(spark, conf.input_dir), conf, args.again, names)


@command
def flows(spark, args, conf):
    """captures to a table of flows"""
    _write(sessionize.flows(pipeline.assembled(pcap.read(spark, args.input), conf)), args)


@command
def extract(spark, args, conf):
    """captures to sequences of features"""
    found = features.with_features(pipeline.assembled(pcap.read(spark, args.input), conf))
    _write(features.sequences(found, conf.feature_types), args)


@command
def matrices(spark, args, conf):
    """sequences to the scores of all stretches of one feature"""
    _write(segments.matrix_rows(spark.read.parquet(args.input), args.feature, conf.lambda_dict.get(args.feature, segments.SMOOTHING), conf.max_flow_length), args)


@command
def fuse(spark, args, conf):
    """sequences to the fused scores of all stretches"""
    names = features.checked(conf.feature_types)
    _write(segments.fused_rows(spark.read.parquet(args.input), {n: conf.weights.get(n, 1.0) for n in names}, conf.lambda_dict, conf.regularization_lambda, conf.max_flow_length), args)


@command
def divide(spark, args, conf):
    """sequences to marks, as JSON lines too"""
    names = features.checked(conf.feature_types)
    marks = segments.divide(spark.read.parquet(args.input), conf.num_phases, {n: conf.weights.get(n, 1.0) for n in names}, conf.lambda_dict, conf.regularization_lambda, conf.max_flow_length, ("pcap", "flow_id"))
    _write(marks, args)
    tables.marks_to_json(spark.read.parquet(args.output)).write.mode("overwrite").text(f"{args.output}_json")


@command
def split_phases(spark, args, conf):
    """captures and marks to a capture for each phase"""
    flows_of = sessionize.reassembled(pcap.read(spark, args.input, with_raw=True), conf.timeout_sec, conf.max_flow_length)
    if args.marks.endswith("_json"):
        marks = tables.marks_from_json(spark.read.text(args.marks), conf.num_phases[0])
        keys = ("flow_id",)
    else:
        marks, keys = spark.read.parquet(args.marks).filter(F.col("num_phases") == conf.num_phases[0]), ("pcap", "flow_id")
    pcap.write(split.with_phase(flows_of, marks, keys), args.output).write.mode("overwrite").parquet(f"{args.output}/_files")


@command
def meter(spark, args, conf):
    """packets with phases to statistics"""
    _write(pipeline.metered(spark.read.parquet(args.input), conf), args)


@command
def concat_phases(spark, args, conf):
    """CSV files of statistics by phase to one wide CSV file a capture"""
    phases = list(range(1, conf.num_phases[0] + 1))
    rows = tables.read_phase_features(spark, args.input, phases, args.basename)
    named = [c for c in rows.columns if c not in pipeline.NOT_FEATURES and c not in conf.concat_mask]
    tables.write_csv_files(concat.wide(rows, named, phases, conf.concat_timeout_sec), args.output, "_concat")


@command
def label_flows(spark, args, conf):
    """wide CSV files to labelled CSV files"""
    rules = label.load_rules(args.rules or conf.rules_path)
    tables.write_csv_files(pipeline.labelled_table(tables.read_wide(spark, args.input), rules, conf), args.output, "_labeled")


def _profiled(sizes: DataFrame, value: str, args: argparse.Namespace) -> None:
    profile.statistics(sizes, value).write.mode("overwrite").json(f"{args.output}/statistics")
    profile.quantiles(sizes, value).write.mode("overwrite").json(f"{args.output}/quantiles")
    profile.histogram(sizes, value).write.mode("overwrite").json(f"{args.output}/histogram")
    report = profile.report(sizes, value)
    args.spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/report")
    print(report)


@command
def capture_profile(spark, args, conf):
    """packets a flow of captures"""
    _profiled(profile.flow_sizes(pcap.read(spark, args.input), args.idle), "n", args)


@command
def csv_profile(spark, args, conf):
    """packets a flow of CSV tables"""
    rows = spark.read.option("header", True).csv(args.input)
    rows = rows.withColumns({c: F.col(f"`{c}`").cast("double") for c in (args.forward, args.backward)})
    _profiled(profile.totals(rows, args.forward, args.backward), "total", args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phaseflow")
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        if name == "run":
            p.add_argument("config")
            p.add_argument("--input")
            p.add_argument("--output")
            p.add_argument("--again", action="store_true", help="do what is done again")
            continue
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--config", help="INI file; defaults if left out")
        p.add_argument("--phases", type=int, help="number of phases")
    given = {n: p for n, p in sub.choices.items()}
    given["matrices"].add_argument("--feature", required=True)
    given["split-phases"].add_argument("--marks", required=True)
    given["concat-phases"].add_argument("--basename")
    given["label-flows"].add_argument("--rules")
    given["capture-profile"].add_argument("--idle", type=float, default=120.0)
    given["csv-profile"].add_argument("--forward", default="Tot Fwd Pkts")
    given["csv-profile"].add_argument("--backward", default="Tot Bwd Pkts")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = reachable(spark or SparkSession.builder.appName("phaseflow").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    register(spark)
    args.spark = spark
    conf = settings.load(str(Path(args.config)), spark.conf.get("spark.sql.session.timeZone")) if args.config else settings.Config()
    if getattr(args, "phases", None):
        conf = replace(conf, num_phases=(args.phases,))
    COMMANDS[args.command](spark, args, conf)


if __name__ == "__main__":
    main()
