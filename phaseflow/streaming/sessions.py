"""Flow assembly over a stream of packets.

The same rules as :mod:`phaseflow.operators.sessionize`, kept as state of a flow key: packets of a key are taken in
order of ``pkt_no`` within a batch, and batches follow each other. The state of a key is dropped when the watermark of
``event_time`` has passed its last packet by the idle timeout: whatever comes later starts a new flow anyway, whose
index goes on from 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phaseflow.functions import packets as P

STATE = "last double, idx int, n int, first double, ip string, port int"
OUT = "flow_key string, pkt_no long, flow_idx int, pos int, kept boolean, direction int, first_ts double"


class Assembler:
    """State of one key."""

    def __init__(self, timeout: float, longest: int, state: tuple | None = None):
        self.timeout, self.longest = timeout, longest
        self.last, self.idx, self.n, self.first, self.ip, self.port = state or (None, -1, 0, None, None, None)

    def state(self) -> tuple:
        return self.last, self.idx, self.n, self.first, self.ip, self.port

    def _open(self, ts: float | None, ip: str | None, port: int | None) -> None:
        self.idx, self.n, self.first, self.ip, self.port = self.idx + 1, 0, ts, ip, port

    def take(self, ts: float, ip: str, port: int, fin: bool) -> tuple[int, int, bool, int, float]:
        """(flow index, place, taken, direction, start of the flow) of a packet."""
        if self.idx < 0 or (self.last is not None and ts - self.last > self.timeout):
            self._open(ts, ip, port)
        self.last = ts
        self.n += 1
        kept = self.n <= self.longest
        if self.first is None or (self.n == 1 and self.first == 0):
            self.first = ts
        out = self.idx, self.n, kept, 1 if (ip, port) == (self.ip, self.port) else -1, self.first
        if fin and kept:
            self._open(None, None, None)
            self.last = None
        elif fin:
            self._open(ts, ip, port)
        return out


def assembled(packets: DataFrame, timeout: float = 600.0, longest: int = 1000) -> DataFrame:
    """Flow index, place, start and direction of each packet of a stream with ``event_time`` and a watermark on it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        if held is not None:
            held = tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in held)
        flow = Assembler(timeout, longest, held)
        df = pd.concat(list(batches)).sort_values("pkt_no")
        rows = [flow.take(ts, ip, int(port), bool(fin)) for ts, ip, port, fin in zip(df.ts_s, df.src_ip, df.src_port, df.is_fin, strict=True)]
        state.update(flow.state())
        at = int((max(df.ts_s) + timeout) * 1000) + 1
        if at > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(at)
        out = pd.DataFrame(rows, columns=["flow_idx", "pos", "kept", "direction", "first_ts"])
        out.insert(0, "pkt_no", df.pkt_no.to_numpy())
        out.insert(0, "flow_key", key[0])
        yield out

    df = packets.filter(P.with_ports()).withColumn("flow_key", P.flow_key()).withColumn("is_fin", P.terminates())
    df = df.select("flow_key", "pkt_no", "ts_s", "src_ip", "src_port", "is_fin", "event_time")
    return df.groupBy("flow_key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def with_event_time(packets: DataFrame, delay: str = "10 minutes") -> DataFrame:
    stamp = F.timestamp_micros((F.col("ts_s") * 1e6).cast("long"))
    return packets.withColumn("event_time", stamp).withWatermark("event_time", delay)
