from __future__ import annotations

import itertools

import numpy as np
import pytest

from phaseflow.functions.udfs import register
from phaseflow.operators import segments, split
from phaseflow.plans import views


def test_worked_example():
    x = np.array([1.0, 1, 5, 5])
    j = segments.score_matrix(x)
    assert j[0, 1] == j[2, 3] == pytest.approx(1000) and j[1, 2] == pytest.approx(0.124984, abs=1e-6)
    assert (j[0, 2], j[0, 3], j[1, 3]) == pytest.approx((0.187465,) * 3, abs=1e-6)
    fused = segments.fused_matrix([x], [1.0], [1e-3])
    assert np.allclose(np.diag(fused), 1e-3) and segments.divisions(fused, 2) == {2: [2]}


@pytest.mark.parametrize("whole", [True, False])
def test_scores_are_inverse_variances(whole):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, 30).astype(float) if whole else rng.standard_normal(30) * 1e3
    j = segments.score_matrix(x, 1e-3)
    for s, t in itertools.combinations(range(30), 2):
        assert j[s, t] == pytest.approx(1 / (np.var(x[s : t + 1], ddof=1) + 1e-3), rel=1e-9)
    assert not np.tril(j).any()


@pytest.mark.parametrize("seed", range(8))
def test_best_division(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 9))
    fused = np.triu(rng.integers(0, 4, (n, n)).astype(float))  # many ties
    for p, marks in segments.divisions(fused, 5).items():
        def value(cuts):
            b = [0, *cuts, n]
            return sum(fused[b[i], b[i + 1] - 1] for i in range(len(b) - 1))

        every = list(itertools.combinations(range(1, n), p - 1))
        top = max(value(c) for c in every)
        assert tuple(marks) == min((c for c in every if value(c) == top), key=lambda c: c[::-1])
    assert set(segments.divisions(fused, 5)) == set(range(2, min(5, n) + 1))


def test_flat_features_and_ties():
    assert segments.divisions(segments.fused_matrix([np.array([0.0, 1e5, 0, 1e5])], [1.0], [1e-3]), 3) == {2: [1], 3: [1, 2]}


def test_divide_and_split(spark):
    seq = spark.createDataFrame([("a", [1.0, 1.0, 5.0, 5.0]), ("b", [1.0]), ("c", [1.0, float("inf"), 2.0]), ("d", None)], "flow_id string, x array<double>")
    marks = segments.divide(seq, [1, 2, 3, 9], {"x": 1.0})
    found = {(r.flow_id, r.num_phases): r.marks for r in marks.collect()}
    assert set(found) == {("a", 2), ("a", 3)} and found["a", 2] == [2]
    packets = spark.createDataFrame([("a", i) for i in range(1, 5)] + [("b", 1)], "flow_id string, pos int")
    got = split.with_phase(packets, marks.filter("num_phases = 2")).collect()
    assert {(r.flow_id, r.pos): r.phase for r in got} == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 2, ("b", 1): 1}


def test_relational_form_equals_kernel(spark):
    rows = [("f", i + 1, v) for i, v in enumerate([3, 3, 9, 1, 1, 1])]
    df = spark.createDataFrame(rows, "flow_id string, pos int, length int")
    scores = segments.scored(segments.moments(df, "length"))
    want = segments.score_matrix(np.array([r[2] for r in rows], float))
    for r in scores.collect():
        assert r.j == want[r.s, r.t]
    fused = segments.fused_matrix([[r[2] for r in rows]], [0.5], [1e-3])
    assert all(r.fused == fused[r.s, r.t] for r in segments.fused({"l": scores}, {"l": 0.5}).collect())


def test_sql_function(spark):
    register(spark)
    assert spark.sql("select phase_marks(array(1D, 1D, 5D, 5D), 2) m").first().m == [2]
    assert spark.sql("select phase_marks(array(1D), 2) m").first().m is None


def test_views(spark):
    rows = [("c", k, float(k), *(("1.1.1.1", "2.2.2.2", 5, 80) if k % 2 else ("2.2.2.2", "1.1.1.1", 80, 5)), 6, 60 + k, 16) for k in range(10)]
    packets = spark.createDataFrame(rows, "pcap string, pkt_no long, ts_s double, src_ip string, dst_ip string, src_port int, dst_port int, proto int, length int, tcp_flags int")
    views.register(spark, packets, phases=3)
    assert spark.sql("SELECT n_packets FROM flows").first().n_packets == 10
    marks = spark.sql("SELECT m.marks, phase_marks(s.packet_length, 3) AS one FROM marks m JOIN sequences s USING (pcap, flow_id) WHERE num_phases = 3").first()
    assert len(marks.marks) == len(marks.one) == 2
    sizes = {r.phase: r.n for r in spark.sql("SELECT phase, count(*) AS n FROM phases GROUP BY phase").collect()}
    assert sizes == {1: marks.marks[0], 2: marks.marks[1] - marks.marks[0], 3: 10 - marks.marks[1]}
    assert spark.sql("SELECT sum(`Total Fwd Packet` + `Total Bwd packets`) AS n FROM meter").first().n == 10
    for name in ("packets", "flows", "sequences", "marks", "phases", "meter"):
        spark.catalog.dropTempView(name)
