"""Packet tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a packet table, in order.
PACKETS = "pcap string, pkt_no bigint, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, length int, tcp_flags int"


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a time zone."""
    if df.schema[name].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def packets_from_events(events: DataFrame) -> DataFrame:
    """Events as packets between a user's address and one server.

    Packets with ``k`` under 50 go to the server, others come from it. Every 97th packet has no client port; ``view``
    events are UDP; ``error`` events carry FIN.
    """
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    client = F.concat(F.lit("10.0."), F.floor(user / 250).cast("string"), F.lit("."), (user % 250).cast("string"))
    port = F.when(F.col("event_id") % 97 == 0, 0).otherwise((F.lit(40000) + user % 1000).cast("int"))
    to_server = k < 50
    server, service = F.lit("192.168.0.1"), F.lit(443)
    udp = F.col("event_type") == "view"
    return events.select(
        F.lit("events").alias("pcap"),
        F.col("event_id").alias("pkt_no"),
        (epoch_us(events, "ts") / 1e6).alias("ts_s"),
        F.when(to_server, client).otherwise(server).alias("src_ip"),
        F.when(to_server, server).otherwise(client).alias("dst_ip"),
        F.when(to_server, port).otherwise(service).alias("src_port"),
        F.when(to_server, service).otherwise(port).alias("dst_port"),
        F.when(udp, 17).otherwise(6).alias("proto"),
        F.floor("value").cast("int").alias("length"),
        F.when(~udp, F.when(F.col("event_type") == "error", 1).otherwise(16)).alias("tcp_flags"),
    )


def disordered(packets: DataFrame) -> DataFrame:
    """The same packets in another order: numbers are multiplied, modulo a prime."""
    return packets.withColumn("pkt_no", F.col("pkt_no") * 7919777 % 1000000007)


def with_headers(packets: DataFrame) -> DataFrame:
    """Header, payload and window columns that captures have, made from packet numbers."""
    tcp = F.col("proto") == 6
    return packets.withColumns({
        "header_length": F.when(tcp, 20 + F.col("pkt_no") % 6 * 4).otherwise(8).cast("int"),
        "payload_length": F.greatest(F.col("length") - 54, F.lit(0)),
        "window": F.when(tcp, F.col("pkt_no") * 37 % 65536).cast("int"),
    })


def flows_from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns as packets of one flow each conversation: (flow_id, pos, length, direction)."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("flow_id"),
        (F.col("turn") + 1).cast("int").alias("pos"),
        F.length("text").cast("int").alias("length"),
        F.when(F.col("role") == "assistant", -1).otherwise(1).alias("direction"),
    )
