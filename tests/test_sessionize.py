from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phaseflow.operators import features, sessionize
from phaseflow.sources.adapters import PACKETS
from phaseflow.streaming.sessions import Assembler

FIN, ACK = 1, 16


def packet(no, ts, src="a", sport=1, flags=ACK, proto=6, length=54):
    dst, dport = ("b", 2) if src == "a" else ("a", 1)
    return ("p", no, float(ts), src, dst, sport if src == "a" else 2, dport if src == "a" else 1, proto, length, flags)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def loop(rows, timeout, longest):
    """Packets of one key one by one."""
    flow = Assembler(timeout, longest)
    return {r[1]: flow.take(r[2], r[3], r[5], r[9] is not None and bool(r[9] & 5)) for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_loop(spark, seed):
    rng = random.Random(seed)
    timeout, longest = rng.choice([2, 5]), rng.randint(1, 4)
    rows, ts = [], 10.0
    for no in range(120):
        ts += rng.choice([0, 1, 1, timeout, timeout + 1, -1])
        rows.append(packet(no, ts, rng.choice("ab"), flags=rng.choice([FIN, 4, ACK, ACK, ACK, None])))
    got = sessionize.assigned(frame(spark, rows), timeout, longest).collect()
    assert {r.pkt_no: (r.flow_idx, r.pos, r.kept, r.direction, r.first_ts) for r in got} == loop(rows, timeout, longest)


TEN = [packet(i, t, flags=FIN if i == 7 else ACK) for i, t in enumerate([0, 1, 2, 3, 4, 75, 6, 7, 8, 9])]


def flows(df):
    out = {}
    for r in df.orderBy("pkt_no").collect():
        out.setdefault(r.flow_idx, []).append(r)
    return out


def test_ten_packets(spark):
    got = flows(features.with_features(sessionize.flow_packets(frame(spark, TEN))))
    assert list(got) == [0] and len(got[0]) == 8
    assert [r.inter_arrival_time for r in got[0]] == [0, 1, 1, 1, 1, 71, -69, 1]
    assert [round(r.up_down_rate, 6) for r in got[0]] == [0, *[53.999946] * 4, 0.760563, -0.782609, 53.999946]
    assert {r.direction for r in got[0]} == {1}
    got = flows(sessionize.flow_packets(frame(spark, TEN), timeout=60))
    assert {k: len(v) for k, v in got.items()} == {0: 5, 1: 3}
    got = flows(sessionize.flow_packets(frame(spark, TEN), min_length=1))
    assert [r.direction for r in got[1]] == [-1, -1]


def test_length_cap(spark):
    rows = [packet(i, t, flags=FIN if t == 4 else ACK) for i, t in enumerate([0, 1, 2, 3, 4, 5, 6])]
    got = flows(sessionize.flow_packets(frame(spark, rows), max_length=3, min_length=1))
    assert [r.ts_s for r in got[0]] == [0, 1, 2] and [r.ts_s for r in got[1]] == [5, 6]
    assert got[1][0].first_ts == 4 and got[1][0].direction == 1
    got = flows(sessionize.reassembled(frame(spark, rows), max_length=3))
    assert [r.ts_s for r in got[0]] == [0, 1, 2, 4] and got[1][0].first_ts == 5
    late = [r if r[2] < 5 else (*r[:2], r[2] + 1000, *r[3:]) for r in rows]
    got = flows(sessionize.flow_packets(frame(spark, late), max_length=3, min_length=1))
    assert list(got) == [0, 2] and got[2][0].first_ts == 1005
    assert list(flows(sessionize.reassembled(frame(spark, late), max_length=3))) == [0, 1]


def test_key_merges_crossed_ports(spark):
    rows = [("p", 0, 1.0, "10.0.0.1", "10.0.0.2", 5, 7, 6, 60, ACK), ("p", 1, 2.0, "10.0.0.1", "10.0.0.2", 7, 5, 6, 60, ACK), ("p", 2, 3.0, "10.0.0.9", "10.0.0.10", 1, 0, 6, 60, ACK)]
    got = sessionize.assigned(frame(spark, rows)).orderBy("pkt_no").collect()
    assert [(r.flow_key, r.direction) for r in got] == [("10.0.0.1-10.0.0.2-5-7-6", 1), ("10.0.0.1-10.0.0.2-5-7-6", -1)]


def test_one_shuffle(spark):
    plan = sessionize.assigned(frame(spark, TEN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sequences(spark):
    df = features.with_features(sessionize.flow_packets(frame(spark, TEN)))
    row = features.sequences(df, ["packet_length", "up_down_ratio"]).first()
    assert row.n == 8 and row.packet_length == [54.0] * 8 and len(row.up_down_rate) == 8
    with pytest.raises(ValueError, match="unknown"):
        features.checked(["nothing"])
    assert sessionize.assigned(frame(spark, [])).count() == 0


def test_stream(spark, tmp_path):
    from phaseflow.streaming import sessions

    rng = random.Random(9)
    rows, ts = [], 1000.0
    for no in range(60):
        ts += rng.choice([0, 1, 7])
        rows.append(packet(no, ts, rng.choice("ab"), flags=rng.choice([FIN, ACK, ACK])))
    for k in range(3):
        frame(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.assembled(sessions.with_event_time(stream), 5, 3)
    run = out.writeStream.format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.pkt_no: (r.flow_idx, r.pos, r.kept, r.direction, r.first_ts) for r in spark.table("flows").collect()}
    assert got == loop(rows, 5, 3)
    assert out.select(F.lit(1)).isStreaming
