"""CSV tables of flow features, wide tables and marks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other spellings of columns, old to present.
ALIASES = {
    "Tot Fwd Pkts": "Total Fwd Packet",
    "Total Fwd Packets": "Total Fwd Packet",
    "Tot Bwd Pkts": "Total Bwd packets",
    "Total Bwd Packets": "Total Bwd packets",
    "Total Length of Fwd Packets": "Total Length of Fwd Packet",
    "Total Length of Bwd Packets": "Total Length of Bwd Packet",
}


def renamed(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def _file_name() -> Column:
    """The name of a row's file; Spark gives it as part of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_phase_features(spark: SparkSession, folder: str, phases: Sequence[int], basename: str | None = None) -> DataFrame:
    """``p_<k>_<basename>.csv`` of all phases, with ``basename``, ``phase`` and ``row_no``, the order within a file.

    Values are text; aggregation casts what it reads. Phases without a file are left out.
    """
    glob = f"p_*_{basename or '*'}.csv"
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(folder)
    name = F.regexp_extract(_file_name(), r"^p_\d+_(.*)\.csv$", 1)
    phase = F.regexp_extract(_file_name(), r"^p_(\d+)_", 1).cast("int")
    df = df.select("*", name.alias("basename"), phase.alias("phase"), F.monotonically_increasing_id().alias("row_no"))
    return renamed(df.filter(F.col("phase").isin(list(phases))))


def read_wide(spark: SparkSession, folder: str) -> DataFrame:
    """``*_concat.csv`` with ``basename``; columns of phases are numbers, so files are read once."""
    df = spark.read.option("header", True).option("pathGlobFilter", "*_concat.csv").csv(folder)
    df = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in df.columns if re.search(r"_p\d+$", c)})
    return df.withColumn("basename", F.regexp_extract(_file_name(), r"^(.*)_concat\.csv$", 1))


def write_csv(df: DataFrame, path: str) -> None:
    """Header and no index; files appear only when the write commits."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_files(df: DataFrame, folder: str, end: str, name: str = "basename") -> None:
    """``<basename><end>.csv`` in ``folder``, one file each: for tools that want them; a task writes a whole one.

    Rows are written below a folder of their own first and files are moved one by one, so no file is ever half there.
    """
    spark = df.sparkSession
    part = f"{folder.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    df.withColumn("__name", F.col(name)).repartition(name).write.partitionBy("__name").option("header", True).csv(part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for sub in store.listStatus(path(part)):
        key, _, value = sub.getPath().getName().partition("=")
        if key != "__name":
            continue
        made = [f.getPath() for f in store.listStatus(sub.getPath()) if f.getPath().getName().startswith("part-")]
        for k, at in enumerate(sorted(made, key=str)):
            to = path(f"{folder}/{unquote(value)}{f'.{k}' if k else ''}{end}.csv")
            store.delete(to, False)
            store.rename(at, to)
    store.delete(path(part), True)


def marks_to_json(marks: DataFrame) -> DataFrame:
    """One JSON object a flow: ``{flow_id: [marks]}``."""
    return marks.select(F.to_json(F.create_map("flow_id", "marks")).alias("value"))


def marks_from_json(lines: DataFrame, num_phases: int) -> DataFrame:
    """Marks from lines that each hold one object or a part of one."""
    entries = F.explode(F.from_json("value", "map<string,array<int>>")).alias("flow_id", "marks")
    return lines.select(entries).select("flow_id", F.lit(num_phases).alias("num_phases"), "marks")


class Stages:
    """Stage tables under one folder, by capture: what a capture has been through is not done again.

    A stage's table is partitioned by ``pcap``. Its rows are written for the captures that are missing only, in one job;
    after that the captures are noted in ``_done``. Captures without a note are written anew, so a job that broke off
    leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, folder: str, captures: Sequence[str], again: bool = False):
        self.spark, self.folder, self.captures, self.again = spark, folder.rstrip("/"), sorted(captures), again

    def done(self, stage: str) -> set[str]:
        if self.again or not finished(self.spark, f"{self.folder}/_done/{stage}"):
            return set()
        notes = self.spark.read.schema("pcap string").json(f"{self.folder}/_done/{stage}")
        return {r.pcap for r in notes.distinct().collect()}  # a row a capture

    def table(self, stage: str, make: Callable[[list[str]], DataFrame]) -> DataFrame:
        """The table of ``stage``, which ``make`` gives for a list of captures."""
        path, missing = f"{self.folder}/{stage}", [c for c in self.captures if c not in self.done(stage)]
        if missing:
            df = make(missing)
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pcap").parquet(path)
            self.spark.createDataFrame([(c,) for c in missing], "pcap string").coalesce(1).write.mode("append").json(f"{self.folder}/_done/{stage}")
            mark, store = _mark(self.spark, path)  # Spark leaves none where it replaces some partitions only
            store.create(mark, True).close()
            return self.spark.read.schema(df.schema).parquet(path).filter(F.col("pcap").isin(self.captures))
        kind = self.spark.read.option("mergeSchema", True).parquet(path).schema
        named = [f if f.name != "pcap" else T.StructField("pcap", T.StringType()) for f in kind.fields]  # a name of digits is text too
        return self.spark.read.schema(T.StructType(named)).parquet(path).filter(F.col("pcap").isin(self.captures))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has committed: what was done before need not be done again."""
    mark, store = _mark(spark, path)
    return store.exists(mark)


def _mark(spark: SparkSession, path: str) -> tuple:
    """The commit marker of a table, and its store."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark, mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
