from __future__ import annotations

import struct

import numpy as np
import pytest

from phaseflow import cli, config
from phaseflow.operators import label, profile
from phaseflow.plans import pipeline
from phaseflow.sources import pcap, tables


def frame(src="1.1.1.1", dst="2.2.2.2", sport=10, dport=80, flags=16, vlan=False, proto=6):
    l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0, *(bytes(map(int, a.split("."))) for a in (src, dst)))
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + l4


def test_capture_round_trip(spark, tmp_path):
    frames = [(1.5, frame()), (2.25, frame(vlan=True, flags=17)), (3.0, b"\0" * 12 + b"\x86\xdd" + b"\0" * 40), (3.5, frame(proto=17)), (4.0, frame(sport=0))]
    (tmp_path / "cap1").write_bytes(pcap.encode(frames))
    (tmp_path / "other").write_bytes(b"no capture")
    df = pcap.read(spark, str(tmp_path), with_raw=True)
    got = df.orderBy("pkt_no").collect()
    assert [(r.pkt_no, r.ts_s, r.src_port, r.proto, r.tcp_flags) for r in got] == [(0, 1.5, 10, 6, 16), (1, 2.25, 10, 6, 17), (3, 3.5, 10, 17, None), (4, 4.0, 0, 6, 16)]
    assert got[0].length == 54 and got[1].length == 58 and got[0].pcap == "cap1"
    assert [(r.header_length, r.payload_length, r.window) for r in got[:3]] == [(20, 0, 0), (20, 0, 0), (8, 0, None)]
    back = pcap.blocks(df, ("pcap",), size=3).orderBy("block").collect()
    again = [r for b in back for r in pcap.parse("x", bytes(b.content))]
    assert [(r["ts_s"], r["raw"]) for r in again] == [(r.ts_s, bytes(r.raw)) for r in got]
    whole = pcap.read(spark, str(tmp_path), with_raw=True, whole=True)
    assert sorted(whole.collect()) == sorted(got)


def test_blocks_of_a_capture_are_read_side_by_side(spark, tmp_path):
    frames = [(1.0 + k / 8, frame(sport=1 + k % 50) + b"x" * (k % 7)) for k in range(1000)]
    (tmp_path / "cap a").write_bytes(pcap.encode(frames))
    (tmp_path / "capn").write_bytes(section([(ETHERNET, None), (12, 9)], [(k % 2, k * 1000 + 7, frame()[14 * (k % 2) :]) for k in range(300)]))
    one = pcap.read(spark, str(tmp_path), with_raw=True)
    many = pcap.read(spark, str(tmp_path), with_raw=True, block=2000)
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 1300
    assert {r.pcap for r in one.select("pcap").distinct().collect()} == {"cap a", "capn"}


ETHERNET = pcap.ETHERNET


def section(interfaces, packets, order="<"):
    """A capture in the newer format."""

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(f"{order}I", len(body) + 12)
        return struct.pack(f"{order}I", kind) + size + body + size

    out = block(pcap.SECTION, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link, resolution in interfaces:
        option = struct.pack(f"{order}HHB3x", 9, 1, resolution) + struct.pack(f"{order}HH", 0, 0) if resolution else b""
        out += block(pcap.INTERFACE, struct.pack(f"{order}HHI", link, 0, 0) + option)
    out += block(5, b"statistics..")
    for which, ticks, data in packets:
        out += block(pcap.PACKET, struct.pack(f"{order}IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_newer_format(order):
    first = section([(ETHERNET, None), (12, 9)], [(0, 5_250_000, frame()), (1, 7_000_000_123, frame()[14:])], order)
    second = section([(12, None)], [(0, 1_000_000, frame(proto=17)[14:])], ">")
    simple = struct.pack(">III", pcap.SIMPLE, 16 + 44, 42) + (frame(proto=17)[14:] + b"\0" * 14)[:44] + struct.pack(">I", 60)
    got = list(pcap.parse("x", first + second + simple + b"cut off"))
    assert [(r["pkt_no"], r["ts_ns"], r["link"], r["proto"]) for r in got] == [(0, 5_250_000_000, 1, 6), (1, 7_000_000_123, 12, 6), (2, 1_000_000_000, 12, 17), (3, 0, 12, 17)]


def test_link_type_and_nanoseconds_are_kept(spark, tmp_path):
    raw = [(5_000_000_123 + k, frame()[14:]) for k in range(5)]
    (tmp_path / "cap1").write_bytes(pcap.encode_ns(raw, 12))
    df = pcap.read(spark, str(tmp_path), with_raw=True).withColumn("phase", pcap.F.lit(1))
    paths = pcap.write(df, str(tmp_path / "out")).collect()
    assert [r.path for r in paths] == [str(tmp_path / "out/phase_1/p_1_cap1.12.000000")]
    got = list(pcap.parse("x", open(paths[0].path, "rb").read()))
    assert [(r["ts_ns"], r["raw"], r["link"]) for r in got] == [(*r, 12) for r in raw]


@pytest.mark.parametrize(("order", "magic", "ticks"), [("<", 0xA1B2C3D4, 1e6), (">", 0xA1B2C3D4, 1e6), ("<", 0xA1B23C4D, 1e9)])
def test_byte_orders(order, magic, ticks):
    raw = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 9, 1) + struct.pack(f"{order}IIII", 5, int(ticks / 4), 54, 54) + frame() + b"cut off"
    assert [r["ts_s"] for r in pcap.parse("x", raw)] == [5.25]
    with pytest.raises(ValueError, match="capture"):
        list(pcap.parse("x", b"none"))


def put(folder, name, start, n=8):
    folder.mkdir(exist_ok=True)
    frames = [(start + i, frame(*(("1.1.1.1", "2.2.2.2", 10, 80) if i % 3 else ("2.2.2.2", "1.1.1.1", 80, 10)))) for i in range(n)]
    (folder / name).write_bytes(pcap.encode(frames))


def test_pipeline_and_commands(spark, tmp_path):
    put(tmp_path / "in", "cap1", 10.0)
    (tmp_path / "rules.yaml").write_text("meta: {default_label: B}\nrules:\n- {label: X, priority: 1, match: [{field: proto, op: '==', value: 6}]}\n")
    (tmp_path / "c.ini").write_text("[pss]\nnum_phases = 2,3 ; phases\nfeature_types = packet_length, direction\nweights = {'direction': 2.0}\n[label]\nrules_path = rules.yaml\n")
    conf = config.load(str(tmp_path / "c.ini"))
    assert conf.num_phases == (2, 3) and conf.weights == {"direction": 2.0} and conf.rules_path.endswith("rules.yaml")
    out = tmp_path / "out"
    again = ["run", str(tmp_path / "c.ini"), "--input", str(tmp_path / "in"), "--output", str(out)]
    cli.main(again, spark)
    for p in (2, 3):
        got = spark.read.parquet(str(out / f"labeled_{p}")).collect()
        assert [r.Label for r in got] == ["X", "X"] or [r.Label for r in got] == ["X"]
        assert f"Total Fwd Packet_p{p}" in got[0].asDict() and f"FWD Init Win Bytes_p{p}" in got[0].asDict()
        assert tables.finished(spark, str(out / f"labeled_{p}"))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in out.rglob("*.parquet") if "_marks/" not in str(f)}
    before = files()
    put(tmp_path / "in", "cap2", 50.0)
    cli.main(again, spark)  # the second capture only
    after = files()
    assert {k: after[k] for k in before} == before and len(after) > len(before)
    assert all("pcap=cap2" in k for k in after.keys() - before.keys())
    assert {r.basename for r in spark.read.parquet(str(out / "labeled_3")).collect()} == {"cap1", "cap2"}
    cli.main(["flows", str(tmp_path / "in"), str(tmp_path / "flows")], spark)
    assert [r.n_packets for r in spark.read.parquet(str(tmp_path / "flows")).collect()] == [8, 8]
    cli.main(["capture-profile", str(tmp_path / "in"), str(tmp_path / "profile")], spark)
    assert spark.read.json(str(tmp_path / "profile/statistics")).first().n == 2
    assert spark.read.json(str(tmp_path / "profile/quantiles")).count() == 19
    assert "flows: 2" in spark.read.text(str(tmp_path / "profile/report"), wholetext=True).first().value


def test_a_command_a_stage(spark, tmp_path):
    put(tmp_path / "in", "cap1", 10.0, 12)
    at = lambda *names: [str(tmp_path / n) for n in names]
    ini = tmp_path / "c.ini"
    ini.write_text("[pss]\nfeature_types = packet_length, direction\nnum_phases = 2\n")
    cli.main(["extract", *at("in", "seq"), "--config", str(ini)], spark)
    assert spark.read.parquet(str(tmp_path / "seq")).first().n == 12
    cli.main(["matrices", *at("seq", "mat"), "--feature", "direction"], spark)
    rows = {(r.s, r.t): (r.u, r.j) for r in spark.read.parquet(str(tmp_path / "mat")).collect()}
    x = np.array(spark.read.parquet(str(tmp_path / "seq")).first().direction)
    assert len(rows) == 78 and all(rows[s, t][0] == pytest.approx(x[s : t + 1].mean()) for s, t in rows)
    assert all(rows[s, t][1] == pytest.approx(1 / (x[s : t + 1].var(ddof=1) + 1e-3)) for s, t in rows if s < t)
    cli.main(["fuse", *at("seq", "fused"), "--config", str(ini)], spark)
    cli.main(["divide", *at("seq", "marks"), "--config", str(ini)], spark)
    fused = {(r.s, r.t): r.fused for r in spark.read.parquet(str(tmp_path / "fused")).collect()}
    cut = max(range(1, 12), key=lambda k: fused[0, k - 1] + fused[k, 11])
    assert spark.read.parquet(str(tmp_path / "marks")).first().marks == [cut]
    for marks in ("marks", "marks_json"):
        cli.main(["split-phases", *at("in", f"phased_{marks}"), "--marks", str(tmp_path / marks), "--phases", "2"], spark)
        sizes = [len(list(pcap.parse("x", (tmp_path / f"phased_{marks}/phase_{p}/p_{p}_cap1").read_bytes()))) for p in (1, 2)]
        assert sizes == [cut, 12 - cut]


def test_csv_commands(spark, tmp_path):
    head = "Src IP,Dst IP,Src Port,Dst Port,Protocol,Timestamp,Flow Duration,Total Fwd Packet,Flow ID\n"
    for p in (1, 2):
        (tmp_path / f"phase_{p}").mkdir()
        (tmp_path / f"phase_{p}" / f"p_{p}_day one.csv").write_text(head + f"10.0.0.1,10.0.0.2,1,2,6,01/02/2018 10:00:0{p} AM,5,{p},f\n")
    cli.main(["concat-phases", str(tmp_path), str(tmp_path / "wide"), "--phases", "2"], spark)
    assert [f.name for f in (tmp_path / "wide").iterdir() if f.suffix == ".csv"] == ["day one_concat.csv"]
    (tmp_path / "r.yaml").write_text("rules:\n- {label: X, priority: 1, match: [{field: total_fwd_pkts, op: '==', value: 1}]}\n")
    cli.main(["label-flows", str(tmp_path / "wide"), str(tmp_path / "done"), "--rules", str(tmp_path / "r.yaml")], spark)
    row = spark.read.option("header", True).csv(str(tmp_path / "done" / "day one_labeled.csv")).first()
    assert (row["Flow Key"], row["Total Fwd Packet_p2"], row.Label) == ("10.0.0.1-10.0.0.2-1-2-6", "2.0", "X")
    cli.main(["csv-profile", str(tmp_path / "phase_1"), str(tmp_path / "dist"), "--forward", "Total Fwd Packet", "--backward", "Flow Duration"], spark)
    assert spark.read.json(str(tmp_path / "dist/histogram")).count() == 50


#: A file as users have it: comments, doubled percent signs, keys of thread pools.
INI = """[pss]
allowed_feature_names = packet_length,inter_arrival_time,direction,up_down_rate
num_phases = 2,3,4  ; list
max_flow_length = 1000
min_flow_length = 3
timeout_sec = 600
lambda_dict = {"packet_length": 1e-3, "inter_arrival_time": 1e-6, "up_down_rate": 1e-3, "direction": 1e-3}
feature_weights = {"packet_length": 0.5, "inter_arrival_time": 0.3, "up_down_rate": 0.1, "direction": 0.1}
regularization_lambda = 1e-3
short_threshold = 10
long_threshold = 100
batch_size = 100

[cfm]
max_workers = 8
timeout_min = 60

[concat]
max_workers = 8
mask_features = Flow ID, Label

[label]
max_workers = 8
mask_features = Flow ID
rules_file = rules/some.yaml
time_zone_adjustment = 0
time_format = %%d/%%m/%%Y %%I:%%M:%%S %%p

[pipeline]
pcap_workers = 50
"""


def test_settings(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text(INI)
    conf = config.load(str(path))
    assert conf.weights == {"packet_length": 0.5, "inter_arrival_time": 0.3, "up_down_rate": 0.1, "direction": 0.1}
    assert conf.lambda_dict["inter_arrival_time"] == 1e-6 and conf.num_phases == (2, 3, 4)
    assert (conf.timeout_sec, conf.max_flow_length, conf.concat_mask, conf.label_mask) == (600.0, 1000, ("Flow ID", "Label"), ("Flow ID",))
    assert conf.rules_path == str(tmp_path / "rules/some.yaml") and conf.time_format == "dd/MM/yyyy hh:mm:ss a" and conf.rule_zone == ""
    path.write_text(INI.replace("time_zone_adjustment = 0", "time_zone_adjustment = yes"))
    assert config.load(str(path), "America/Halifax").rule_zone == "America/Halifax"
    path.write_text(INI.replace("time_zone_adjustment = 0", "time_zone = Asia/Tokyo"))
    assert config.load(str(path)).rule_zone == "Asia/Tokyo"
    assert config.time_pattern("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    for wrong in (INI.replace("feature_weights", "feature_weigths"), INI.replace("[cfm]", "[cmf]"), INI.replace("= 1000", "= many"), INI.replace("%%p", "%%Q")):
        path.write_text(wrong)
        with pytest.raises(config.ConfigError):
            config.load(str(path))


#: Every construct that rule files use.
RULES = """
meta: {default_label: BENIGN}
rules:
- {label: one, priority: 10, match: [{field: src_ip, op: "==", value: 10.0.0.1}, {field: time_window, op: range, value: ["2018-02-14T14:00:00", "2018-02-14T15:00:00"]}]}
- {label: two, priority: 20, match: [{field: any_ip, op: in, value: [10.0.0.9]}, {field: dst_port, op: in, value: [80, 443]}, {field: zero_fwd, op: "==", value: true}]}
- {label: three, priority: 30, match: [{field: time_start, op: ">=", value: "2018-02-15T00:00:00"}, {field: time_end, op: "<=", value: "2018-02-15T23:00:00"}, {field: flow_duration, op: ">", value: 4}, {field: proto, op: "==", value: 6}]}
- label: four
  priority: 40
  match: [{field: src_port, op: "!=", value: 1}, {field: dst_ip, op: not_in, value: [10.0.0.2]}, {field: time_window, op: ranges, value: [["2018-02-16T10:00:00", "2018-02-16T11:00:00"], ["2018-02-17T10:00:00", "2018-02-17T11:00:00"]]}]
  extra_logic: {any_of: [{field: total_fwd_pkts, op: "<", value: 3}, {all_of: [{field: total_bwd_len, op: "<=", value: 9}, {field: fwd_rst_flags, op: ">=", value: 1}]}]}
- {label: five, priority: 50, match: [{field: any, op: "==", value: true}, {field: bwd_rst_flags, op: ">", value: 5}, {field: total_fwd_len, op: "==", value: 7}]}
"""


def test_rules_under_a_file_of_settings(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/some.yaml").write_text(RULES)
    (tmp_path / "c.ini").write_text(INI)
    conf = config.load(str(tmp_path / "c.ini"))
    rows = [  # key, stamp, duration in microseconds, packets, forward and backward bytes, resets, label
        ("10.0.0.1-10.0.0.2-1-2-6", "14/02/2018 02:30:00 PM", 1e6, 9, 5, 5, 0, "one"),
        ("10.0.0.1-10.0.0.2-1-2-6", "14/02/2018 02:30:00 AM", 1e6, 9, 5, 5, 0, "BENIGN"),
        ("10.0.0.1-10.0.0.9-1-443-6", "14/02/2018 02:30:00 PM", 1e6, 9, 0, 5, 0, "two"),
        ("10.0.0.3-10.0.0.2-1-2-6", "15/02/2018 12:30:00 PM", 5e6, 9, 5, 5, 0, "three"),
        ("10.0.0.3-10.0.0.2-1-2-17", "15/02/2018 12:30:00 PM", 5e6, 9, 5, 5, 0, "BENIGN"),
        ("10.0.0.3-10.0.0.4-5-2-17", "17/02/2018 10:30:00 AM", 5e6, 2, 5, 50, 0, "four"),
        ("10.0.0.3-10.0.0.4-5-2-17", "16/02/2018 09:59:58 AM", 5e6, 9, 5, 9, 1, "four"),
        ("10.0.0.3-10.0.0.4-5-2-17", "16/02/2018 09:59:58 AM", 5e6, 9, 5, 10, 1, "BENIGN"),
        ("10.0.0.3-10.0.0.4-5-2-17", "18/02/2018 09:59:58 AM", 5e6, 9, 7, 10, 6, "five"),
    ]
    names = ["Flow Key", "Timestamp", "Flow Duration_p1", "Total Fwd Packet_p1", "Total Length of Fwd Packet_p1", "Total Length of Bwd Packet_p1", "RST Flag Count_p1", "want"]
    df = spark.createDataFrame([(*r[:2], *map(float, r[2:7]), r[7]) for r in rows], names)
    got = pipeline.labelled_table(df, label.load_rules(conf.rules_path), conf).select("want", "Label").collect()
    assert [r.Label for r in got] == [r.want for r in got]


def test_csv_tables(spark, tmp_path):
    (tmp_path / "phase_1").mkdir()
    (tmp_path / "phase_1" / "p_1_x_y.csv").write_text("Src IP,Tot Fwd Pkts\n1,5\n")
    (tmp_path / "phase_1" / "p_9_x_y.csv").write_text("Src IP,Tot Fwd Pkts\n1,7\n")
    got = tables.read_phase_features(spark, str(tmp_path), [1, 2]).collect()
    assert [(r.basename, r.phase, r["Total Fwd Packet"]) for r in got] == [("x_y", 1, "5")]
    marks = spark.createDataFrame([("a-1", [2, 5]), ("b", [1])], "flow_id string, marks array<int>")
    back = tables.marks_from_json(tables.marks_to_json(marks), 3)
    assert {r.flow_id: r.marks for r in back.collect()} == {"a-1": [2, 5], "b": [1]}


def test_profile(spark):
    df = spark.createDataFrame([(i, 0) for i in range(101)], "`Tot Fwd Pkts` int, `Tot Bwd Pkts` int")
    t = profile.totals(df)
    s = profile.statistics(t, above=(100,)).first()
    assert (s.n, s["mean"], s["median"], round(s["std"], 6), s.pct_above_100) == (100, 50.5, 50.5, 29.011492, 0)
    q = {round(r.q, 2): r.value for r in profile.quantiles(t).collect()}
    assert q[0.9] == pytest.approx(90.1) and q[0.05] == pytest.approx(5.95)
    h = profile.histogram(t).collect()
    assert len(h) == 50 and sum(r.n for r in h) == 100 and {r.n for r in h} == {2}
    one = sorted(profile.histogram(t.filter("total = 7")).collect())
    assert len(one) == 50 and [r.bin for r in one if r.n] == [26] and (one[0].low, one[-1].high) == (6.5, 7.5)
    assert profile.histogram(t.filter("false")).count() == 0
    assert "- median: 50.5" in profile.report(t) and "flows: 0" in profile.report(t.filter("false"))
