from __future__ import annotations

import math

import pytest

from phaseflow.operators import concat, label

KEY = ("1.1.1.1", "2.2.2.2", 5, 80, 6)
DDL = "basename string, phase int, `Src IP` string, `Dst IP` string, `Src Port` int, `Dst Port` int, Protocol int, Timestamp string, row_no int, `Total Fwd Packet` double, `Idle` double"


def rows(spark, *items, key=KEY):
    return spark.createDataFrame([("b", p, *key, t, i, float(v), None if v == 13 else float(v)) for i, (p, t, v) in enumerate(items)], DDL)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


def test_names_decide():
    cases = {"Fwd Packet Length Max": "sum", "Flow IAT Max": "max", "Active Min": "min", "RST Flag Count": "sum", "Down/Up Ratio": "mean", "Flow Duration": "max", "Total Fwd Packet": "sum", "total": "mean"}
    assert {n: concat.aggregate_for(n) for n in cases} == cases


def test_take_while_carry_and_stamp(spark):
    day = "01/03/2018 "
    df = rows(spark, (1, day + "10:00:00 AM", 1), (2, day + "10:09:59 AM", 2), (2, day + "10:19:58 AM", 4), (2, day + "10:29:58 AM", 8), (3, day + "10:29:57 AM", 16))
    out = one(concat.wide(df, ["Total Fwd Packet", "Idle"], [1, 2, 3, 4]))
    assert [out[f"Total Fwd Packet_p{p}"] for p in (1, 2, 3, 4)] == [1, 6, 16, 16]
    assert out["Idle_p2"] == 3 and out["Timestamp"] == day + "10:00:00 AM" and out["Flow Key"] == "1.1.1.1-2.2.2.2-5-80-6"


def test_string_order_and_missing_values(spark):
    day = "01/03/2018 "
    df = rows(spark, (1, day + "01:00:00 PM", 13), (1, day + "11:00:00 AM", 2), (2, day + "11:05:00 AM", 5))
    out = one(concat.wide(df, ["Total Fwd Packet", "Idle"], [1, 2]))
    assert out["Timestamp"] == day + "01:00:00 PM" and out["Total Fwd Packet_p1"] == 15 and math.isnan(out["Idle_p1"])
    assert out["Total Fwd Packet_p2"] == 5
    late = one(concat.wide(df, ["Total Fwd Packet"], [1, 2], order="time"))
    assert late["Total Fwd Packet_p2"] == 5  # negative gaps count


def test_without_first_phase(spark):
    assert concat.wide(rows(spark, (2, "01/03/2018 10:00:00 AM", 1)), ["Idle"], [1, 2]).count() == 0


WIDE = "`Flow Key` string, Timestamp string, `Flow Duration_p1` double, `Total Length of Fwd Packet_p1` double, `RST Flag Count_p1` double, n double"


def labels(spark, data, rules, **options):
    df = label.with_endpoints(spark.createDataFrame(data, WIDE), mask=["Timestamp", "n"] if options.pop("mask", False) else [])
    return [r.Label for r in label.labelled(df, {"rules": rules}, **options).collect()]


def cond(field, op, value):
    return {"field": field, "op": op, "value": value}


FLOW = ("1.1.1.1-2.2.2.2-5-80-6", "14/02/2018 10:00:00 AM", 5.05e6, 0.0, 1.0, None)


def test_last_match_wins(spark):
    rules = [{"label": "y", "priority": 31, "match": [cond("src_ip", "==", "1.1.1.1")]}, {"label": "x", "priority": 30, "match": []}]
    assert labels(spark, [FLOW], rules, mask=True) == ["y"]
    assert labels(spark, [FLOW], rules, policy="first") == ["x"]
    assert labels(spark, [FLOW], [{"label": "x", "match": [cond("dst_port", "==", 1)]}]) == ["BENIGN"]


@pytest.mark.parametrize(("c", "want"), [
    (cond("n", "!=", 1), True), (cond("n", "==", 1), False), (cond("n", "not_in", [1]), True), (cond("n", "in", [1]), False),
    (cond("n", "<", 1), False), (cond("n", "isnull", True), True), (cond("n", "notnull", True), False),
    (cond("src_port", "not_in", [63782, 64144]), True), (cond("proto", "in", [6, "6", "TCP"]), True), (cond("dst_port", "in", ["80"]), False),
    (cond("any_ip", "in", ["9", "2.2.2.2"]), True), (cond("any", "==", True), True), (cond("zero_fwd", "==", True), True),
    (cond("flow_duration_s", "<=", 5.05), True), (cond("bwd_rst_flags", ">", 0), True), (cond("src_ip", "regex", "1.1"), True),
    (cond("src_ip", "regex", "^2"), False), (cond("dst_ip", "contains", "2$"), True),
    (cond("time_window", "range", ["2018-02-14T09:00:00", "2018-02-14T10:00:00"]), True),
    (cond("time_window", "range", ["2018-02-14T10:00:05.050000", "2018-02-14T11:00:00"]), True),
    (cond("time_window", "range", ["2018-02-14T10:00:05.060000", "2018-02-14T11:00:00"]), False),
    (cond("time_start", "==", "2030-01-01T00:00:00"), True),
])
def test_conditions(spark, c, want):
    assert labels(spark, [FLOW], [{"label": "x", "match": [c]}]) == ["x" if want else "BENIGN"]


def test_unreadable_time_matches_every_window(spark):
    flow = (FLOW[0], "soon", *FLOW[2:])
    rule = [{"label": "x", "match": [cond("time_window", "ranges", [["1990-01-01T00:00:00", "1990-01-02T00:00:00"]])]}]
    assert labels(spark, [flow], rule) == ["x"]
    assert labels(spark, [flow], rule, strict_time=True) == ["BENIGN"]


def test_extra_logic(spark):
    nested = {"any_of": [cond("bwd_rst_flags", "==", 0), {"all_of": [cond("flow_duration_s", ">", 5), cond("dst_port", "==", 80)]}]}
    assert labels(spark, [FLOW], [{"label": "x", "match": [], "extra_logic": nested}]) == ["x"]


@pytest.mark.parametrize("c", [cond("nowhere", "==", 1), cond("src_port", "like", 1), cond("any", "==", False), cond("time_window", "==", 1)])
def test_bad_rules(spark, c):
    with pytest.raises(label.RuleError):
        labels(spark, [FLOW], [{"label": "x", "match": [c]}])
    with pytest.raises(label.RuleError):
        labels(spark, [FLOW], [{"label": "x", "extra_logic": {"none_of": []}}])
