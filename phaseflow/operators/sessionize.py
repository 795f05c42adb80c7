"""Flow assembly in closed form.

Packets of a key are cut, in file order, after a FIN or RST and where the gap to the packet before exceeds the idle
timeout; a flow takes at most ``max_length`` packets. What looks stateful is a few window functions over one
partitioning, so one shuffle on (pcap, flow key) serves the whole operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from phaseflow.functions import packets as P


def by_key() -> WindowSpec:
    return Window.partitionBy("pcap", "flow_key").orderBy("pkt_no")


def segmented(packets: DataFrame, timeout: float) -> DataFrame:
    """Adds flow_key, is_fin, gap, prev_fin, boundary, seg and pos."""
    df = packets.filter(P.with_ports()).withColumn("flow_key", P.flow_key()).withColumn("is_fin", P.terminates())
    df = df.withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(by_key())).withColumn("prev_fin", F.lag("is_fin").over(by_key()))
    df = df.withColumn("late", F.coalesce(F.col("gap") > timeout, F.lit(False)))
    df = df.withColumn("boundary", F.col("prev_fin").isNull() | F.col("prev_fin") | F.col("late"))
    df = df.withColumn("seg", F.sum(F.col("boundary").cast("int")).over(by_key()))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("pcap", "flow_key", "seg").orderBy("pkt_no")))


def assigned(packets: DataFrame, timeout: float = 600.0, max_length: int = 1000) -> DataFrame:
    """Every packet with a flow index and whether its flow takes it (``kept``).

    A FIN or RST on a full flow is dropped and opens the next flow with its own time and sender; one that is taken opens
    a flow whose sender is unknown, so all its directions are -1. The index counts flows that stay empty, too.
    """
    df = segmented(packets, timeout)
    df = df.withColumn("kept", F.col("pos") <= max_length)
    fin_dropped = F.coalesce(F.col("prev_fin") & (F.lag("pos").over(by_key()) > max_length), F.lit(False))
    df = df.withColumn("fin_dropped", fin_dropped)
    step = F.when(F.col("prev_fin").isNull(), 0).otherwise(F.col("boundary").cast("int") + (F.col("fin_dropped") & F.col("late")).cast("int"))
    df = df.withColumn("flow_idx", F.sum(step).over(by_key()).cast("int"))
    from_fin = F.col("fin_dropped") & ~F.col("late")
    unknown = F.coalesce(F.col("prev_fin"), F.lit(False)) & ~F.col("fin_dropped")
    for name, own in (("open_ip", "src_ip"), ("open_port", "src_port"), ("open_ts", "ts_s")):
        value = F.when(from_fin, F.lag(own).over(by_key())).when(unknown & F.lit(name != "open_ts"), None).otherwise(F.col(own))
        df = df.withColumn(name, value)
    seg = Window.partitionBy("pcap", "flow_key", "seg").orderBy("pkt_no")
    first = lambda c: F.first(c).over(seg)
    df = df.withColumn("init_ip", first("open_ip")).withColumn("init_port", first("open_port"))
    opened = first("open_ts")
    df = df.withColumn("first_ts", F.when(opened == 0, first("ts_s")).otherwise(opened))
    sent = F.coalesce((F.col("src_ip") == F.col("init_ip")) & (F.col("src_port") == F.col("init_port")), F.lit(False))
    df = df.withColumn("direction", F.when(sent, 1).otherwise(-1))
    df = df.withColumn("flow_id", P.flow_id(F.col("flow_key"), F.col("flow_idx"), F.col("first_ts")))
    return df.drop("open_ip", "open_port", "open_ts", "init_ip", "init_port", "late", "fin_dropped")


def flow_packets(packets: DataFrame, timeout: float = 600.0, max_length: int = 1000, min_length: int = 3) -> DataFrame:
    """Packets of all flows with at least ``min_length`` packets."""
    seg = Window.partitionBy("pcap", "flow_key", "seg")
    df = assigned(packets, timeout, max_length).filter("kept")
    return df.withColumn("n", F.count(F.lit(1)).over(seg)).filter(F.col("n") >= min_length)


def reassembled(packets: DataFrame, timeout: float = 600.0, max_length: int = 1000) -> DataFrame:
    """The assembly that splits captures by phase: TCP and UDP only, a FIN or RST always ends its own flow.

    A full flow still takes the packet that ends it; flows start with their first packet; there is no least length.
    """
    df = segmented(packets.filter(P.tcp_or_udp()), timeout)
    df = df.filter((F.col("pos") <= max_length) | F.col("is_fin")).withColumn("flow_idx", (F.col("seg") - 1).cast("int"))
    first = F.first("ts_s").over(Window.partitionBy("pcap", "flow_key", "seg").orderBy("pkt_no"))
    df = df.withColumn("first_ts", first)
    return df.withColumn("flow_id", P.rounded_flow_id(F.col("flow_key"), F.col("flow_idx"), F.col("first_ts")))


def flows(assembled: DataFrame) -> DataFrame:
    """One row a flow: size, bytes and times."""
    return assembled.groupBy("pcap", "flow_id").agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.sum("length").alias("n_bytes"),
        F.min("ts_s").alias("start_s"),
        (F.max("ts_s") - F.min("ts_s")).alias("duration_s"),
        F.count_if("is_fin").alias("n_fin"),
    )


def drops(packets: DataFrame, timeout: float = 600.0, max_length: int = 1000, min_length: int = 3) -> DataFrame:
    """Per key: packets that full flows dropped, flows opened, and flows that are put out."""
    df = assigned(packets, timeout, max_length)
    seg = df.groupBy("pcap", "flow_key", "seg").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.max("flow_idx").alias("idx"))
    return seg.groupBy("pcap", "flow_key").agg(
        F.sum("dropped").alias("n_dropped"),
        (F.max("idx") + 1).alias("n_opened"),
        F.count_if(F.col("kept") >= min_length).alias("n_put_out"),
    )
