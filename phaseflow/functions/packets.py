"""Scalar expressions over packet columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128


def flow_key(src_ip: str = "src_ip", dst_ip: str = "dst_ip", src_port: str = "src_port", dst_port: str = "dst_port", proto: str = "proto") -> Column:
    """Bidirectional key; addresses (as text) and ports are ordered independently of each other."""
    a, b, p, q = F.col(src_ip), F.col(dst_ip), F.col(src_port), F.col(dst_port)
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b), F.least(p, q), F.greatest(p, q), F.col(proto))


def endpoint_key(src_ip: str = "src_ip", dst_ip: str = "dst_ip", src_port: str = "src_port", dst_port: str = "dst_port", proto: str = "proto") -> Column:
    """Profile key: address and port of an endpoint stay together; the endpoint with the lesser address comes first."""
    a, b, p, q = F.col(src_ip), F.col(dst_ip), F.col(src_port), F.col(dst_port)
    swap = a > b
    pick = lambda x, y: F.when(swap, y).otherwise(x)
    return F.concat_ws("-", pick(a, b), pick(b, a), pick(p, q), pick(q, p), F.col(proto))


def has_flag(bits: int, flags: str = "tcp_flags") -> Column:
    """Whether any of ``bits`` is set; false without a TCP layer."""
    return F.coalesce(F.col(flags).bitwiseAND(F.lit(bits)) != 0, F.lit(False))


def terminates() -> Column:
    return has_flag(FIN | RST)


def with_ports() -> Column:
    """Packets that flow assembly takes: both ports present."""
    return (F.coalesce(F.col("src_port"), F.lit(0)) != 0) & (F.coalesce(F.col("dst_port"), F.lit(0)) != 0)


def tcp_or_udp() -> Column:
    return F.coalesce(F.col("proto").isin(6, 17), F.lit(False))


def flow_id(key: Column, index: Column, first_ts: Column) -> Column:
    """Key, index and start in whole milliseconds, truncated."""
    return F.concat_ws("-", key, index.cast("string"), F.floor(first_ts * 1000).cast("string"))


def rounded_flow_id(key: Column, index: Column, first_ts: Column) -> Column:
    """Like :func:`flow_id`, with the start first rounded to microseconds."""
    return F.concat_ws("-", key, index.cast("string"), F.floor(F.round(first_ts * 1000000) / 1000).cast("string"))
