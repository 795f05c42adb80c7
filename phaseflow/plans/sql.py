"""DuckDB SQL that gives the rows of the catalogue's queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

PACKETS = r"""
pk0 AS (
  SELECT event_id, epoch_us(ts) / 1e6 AS ts_s, CAST(json_extract_string(props, '$.k') AS INT) < 50 AS fwd, event_type, value,
         '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS client,
         CASE WHEN event_id % 97 = 0 THEN 0 ELSE 40000 + user_id % 1000 END AS port
  FROM events),
pk AS (
  SELECT event_id AS pkt_no, ts_s,
         CASE WHEN fwd THEN client ELSE '192.168.0.1' END AS src_ip, CASE WHEN fwd THEN '192.168.0.1' ELSE client END AS dst_ip,
         CASE WHEN fwd THEN port ELSE 443 END AS src_port, CASE WHEN fwd THEN 443 ELSE port END AS dst_port,
         CASE WHEN event_type = 'view' THEN 17 ELSE 6 END AS proto, CAST(floor(value) AS INT) AS length,
         CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 1 ELSE 16 END AS tcp_flags
  FROM pk0),
pkk AS (
  SELECT *, least(src_ip, dst_ip) || '-' || greatest(src_ip, dst_ip) || '-' || least(src_port, dst_port) || '-' || greatest(src_port, dst_port) || '-' || proto AS flow_key,
         CASE WHEN src_ip > dst_ip THEN dst_ip || '-' || src_ip || '-' || dst_port || '-' || src_port ELSE src_ip || '-' || dst_ip || '-' || src_port || '-' || dst_port END || '-' || proto AS endpoint_key,
         coalesce((tcp_flags & 5) <> 0, false) AS is_fin
  FROM pk)"""

SEGMENTS = (
    PACKETS
    + r""",
s1 AS (SELECT *, ts_s - lag(ts_s) OVER w AS gap, lag(is_fin) OVER w AS pf FROM pkk WHERE src_port <> 0 AND dst_port <> 0 WINDOW w AS (PARTITION BY flow_key ORDER BY pkt_no)),
s2 AS (SELECT *, coalesce(gap > 86400, false) AS late, (pf IS NULL OR pf OR coalesce(gap > 86400, false)) AS boundary FROM s1),
s3 AS (SELECT *, sum(boundary::INT) OVER (PARTITION BY flow_key ORDER BY pkt_no) AS seg FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY flow_key, seg ORDER BY pkt_no) AS pos FROM s3)"""
)

ASSIGNED = (
    SEGMENTS
    + r""",
a1 AS (SELECT *, coalesce(pf AND lag(pos) OVER w > 4, false) AS fd, lag(src_ip) OVER w AS lip, lag(src_port) OVER w AS lport, lag(ts_s) OVER w AS lts
       FROM s4 WINDOW w AS (PARTITION BY flow_key ORDER BY pkt_no)),
a2 AS (SELECT *, sum(CASE WHEN pf IS NULL THEN 0 ELSE boundary::INT + (fd AND late)::INT END) OVER (PARTITION BY flow_key ORDER BY pkt_no)::INT AS flow_idx,
              CASE WHEN fd AND NOT late THEN lip WHEN coalesce(pf, false) AND NOT fd THEN NULL ELSE src_ip END AS oip,
              CASE WHEN fd AND NOT late THEN lport WHEN coalesce(pf, false) AND NOT fd THEN NULL ELSE src_port END AS oport,
              CASE WHEN fd AND NOT late THEN lts ELSE ts_s END AS ots FROM a1),
a3 AS (SELECT *, first_value(oip) OVER w AS iip, first_value(oport) OVER w AS iport, first_value(ots) OVER w AS first_ts
       FROM a2 WINDOW w AS (PARTITION BY flow_key, seg ORDER BY pkt_no)),
asg AS (SELECT *, CASE WHEN coalesce(src_ip = iip AND src_port = iport, false) THEN 1 ELSE -1 END AS direction,
               flow_key || '-' || flow_idx || '-' || CAST(floor(first_ts * 1000) AS BIGINT) AS flow_id FROM a3),
fp AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY flow_key, seg) AS n FROM asg WHERE pos <= 4) WHERE n >= 2)"""
)

ORACLES["q_flow_key"] = f"WITH {PACKETS} SELECT pkt_no, flow_key, endpoint_key, is_fin FROM pkk"
ORACLES["q_port_filter"] = f"""WITH {PACKETS}
SELECT proto, count_if(src_port <> 0 AND dst_port <> 0)::BIGINT AS n_assembled, count_if(src_port <> 0 AND dst_port <> 0 AND proto IN (6, 17))::BIGINT AS n_reassembled,
       count_if(proto IN (6, 17))::BIGINT AS n_profiled FROM pk GROUP BY proto"""
ORACLES["q_sessions"] = f"""WITH {ASSIGNED}
SELECT flow_id, count(*) AS n_packets, sum(length)::BIGINT AS n_bytes, round(min(ts_s), 6) AS start_s, round(max(ts_s) - min(ts_s), 6) AS duration_s, count_if(is_fin)::BIGINT AS n_fin
FROM fp GROUP BY flow_id"""
ORACLES["q_sessions_disorder"] = ORACLES["q_sessions"].replace("event_id AS pkt_no", "event_id * 7919777 % 1000000007 AS pkt_no")
ORACLES["q_flow_ids"] = f"""WITH {ASSIGNED}
SELECT flow_id, min(flow_key || '-' || flow_idx || '-' || CAST(floor(round(first_ts * 1000000) / 1000) AS BIGINT)) AS rounded_id, min(flow_idx) AS flow_idx,
       min(seg)::BIGINT AS seg, round(min(first_ts), 6) AS first_ts FROM fp GROUP BY flow_id"""
ORACLES["q_sessions_recon"] = f"""WITH {SEGMENTS},
r AS (SELECT *, first_value(ts_s) OVER (PARTITION BY flow_key, seg ORDER BY pkt_no) AS f FROM s4 WHERE pos <= 4 OR is_fin)
SELECT flow_key || '-' || (seg - 1) || '-' || CAST(floor(round(f * 1000000) / 1000) AS BIGINT) AS flow_id, count(*) AS n_packets, sum(length)::BIGINT AS n_bytes,
       count_if(is_fin)::BIGINT AS n_fin, round(max(ts_s) - min(ts_s), 6) AS duration_s FROM r GROUP BY 1"""
ORACLES["q_super_flow_drops"] = f"""WITH {ASSIGNED},
g AS (SELECT flow_key, seg, count_if(pos <= 4) AS kept, count_if(pos > 4) AS dropped, max(flow_idx) AS idx FROM asg GROUP BY flow_key, seg)
SELECT flow_key, sum(dropped)::BIGINT AS n_dropped, max(idx) + 1 AS n_opened, count_if(kept >= 2)::BIGINT AS n_put_out FROM g GROUP BY flow_key"""
ORACLES["q_direction"] = f"WITH {ASSIGNED} SELECT pkt_no, flow_id, pos, direction FROM fp"

FEATURED = (
    ASSIGNED
    + r""",
ft AS (SELECT *, coalesce(ts_s - lag(ts_s) OVER (PARTITION BY flow_key, seg ORDER BY pkt_no), 0.0) AS iat FROM fp)"""
)
ORACLES["q_iat"] = f"WITH {FEATURED} SELECT pkt_no, round(iat, 6) AS iat FROM ft"
ORACLES["q_up_down_rate"] = f"""WITH {FEATURED},
rt AS (SELECT pkt_no, round(CASE WHEN pos = 1 THEN 0.0 ELSE CASE WHEN iat + 1e-6 = 0 THEN NULL ELSE length::DOUBLE / (iat + 1e-6::DOUBLE) END * direction END * 1000, 4) AS r FROM ft)
SELECT pkt_no, CASE WHEN r = 0 THEN 0.0::DOUBLE ELSE r END AS rate FROM rt"""

TURNS = r"""
tn AS (SELECT conv_id::VARCHAR AS flow_id, (turn + 1)::INT AS pos, length(text)::INT AS length, CASE WHEN role = 'assistant' THEN -1 ELSE 1 END AS direction FROM conversations)"""
ORACLES["q_seq_arrays"] = f"""WITH {TURNS}
SELECT flow_id, count(*)::INT AS n, string_agg(length::VARCHAR, ',' ORDER BY pos) AS lengths, string_agg(direction::VARCHAR, ',' ORDER BY pos) AS directions FROM tn GROUP BY flow_id"""


def _scores(feature: str, name: str) -> str:
    return f""",
{name}r AS (SELECT flow_id, row_number() OVER w - 1 AS i, {feature}::BIGINT AS x, sum({feature}::BIGINT) OVER w AS sx, sum({feature}::BIGINT * {feature}::BIGINT) OVER w AS sq
            FROM tn WINDOW w AS (PARTITION BY flow_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{name}m AS (SELECT a.flow_id, a.i AS s, b.i AS t, (b.i - a.i + 1)::DOUBLE AS n, (b.sx - a.sx + a.x)::DOUBLE AS total, (b.sq - a.sq + a.x * a.x)::DOUBLE AS square
            FROM {name}r a JOIN {name}r b ON a.flow_id = b.flow_id AND a.i < b.i),
{name} AS (SELECT flow_id, s, t, total / n AS u, square - (total * total) / n AS m, 1.0::DOUBLE / ((square - (total * total) / n) / (n - 1) + 1e-3::DOUBLE) AS j FROM {name}m)"""


ORACLES["q_matrix_umj"] = f"WITH {TURNS}{_scores('length', 'sl')} SELECT flow_id, s, t, round(u, 6) AS u, round(m, 6) AS m, round(j * 1000, 6) AS j FROM sl"
FUSED = f"""{TURNS}{_scores("length", "sl")}{_scores("direction", "sd")},
fu AS (
  SELECT sl.flow_id, sl.s, sl.t,
         0.0::DOUBLE + CASE WHEN max(sl.j) OVER w > 1e-6 THEN 1.0::DOUBLE * (sl.j / max(sl.j) OVER w) ELSE 0.0 END
                     + CASE WHEN max(sd.j) OVER w > 1e-6 THEN 0.5::DOUBLE * (sd.j / max(sd.j) OVER w) ELSE 0.0 END AS f
  FROM sl JOIN sd USING (flow_id, s, t) WINDOW w AS (PARTITION BY sl.flow_id)),
sz AS (SELECT flow_id, count(*) AS n FROM tn GROUP BY flow_id HAVING count(*) >= 2),
al AS (SELECT flow_id, s, t, f FROM fu UNION ALL SELECT flow_id, i, i, 1e-3::DOUBLE FROM sz, unnest(range(n)) AS x(i))"""
_FRACTIONS = f"""{TURNS},
x AS (SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY pos) - 1 AS i, length / 7.0::DOUBLE AS a, direction * 0.3::DOUBLE + pos * 0.1::DOUBLE AS b FROM tn),
g AS (SELECT p.flow_id, p.i AS s, q.i AS t, avg(x.a) AS u, 1 / (var_samp(x.a) + 1e-3::DOUBLE) AS ja, 1 / (var_samp(x.b) + 1e-2::DOUBLE) AS jb
      FROM x p JOIN x q ON p.flow_id = q.flow_id AND p.i <= q.i JOIN x ON x.flow_id = p.flow_id AND x.i BETWEEN p.i AND q.i GROUP BY ALL)"""
ORACLES["q_matrix_fraction"] = f"WITH {_FRACTIONS} SELECT flow_id, s, t, round(u, 6) AS u, round(ja * 1000, 6) AS j FROM g WHERE s < t"
ORACLES["q_fused_fraction"] = f"""WITH {_FRACTIONS}
SELECT flow_id, s, t, round(CASE WHEN s = t THEN 1e-3 ELSE 0.7 * ja / max(ja) OVER w + 0.3 * jb / max(jb) OVER w END::DOUBLE, 6) AS fused FROM g WINDOW w AS (PARTITION BY flow_id)"""
ORACLES["q_fused"] = f"WITH {FUSED} SELECT flow_id, s, t, round(f, 9) AS fused FROM fu"


def _divided(p: int) -> str:
    """Best cuts c1 < ... < c(p-1): of equal sums the one whose last cut is least, then the one before it."""
    cuts = [f"c{k}" for k in range(1, p)]
    joins = ["JOIN al a1 ON a1.flow_id = z.flow_id AND a1.s = 0"]
    total = "a1.f"
    for k in range(2, p + 1):
        end = f" AND a{k}.t = z.n - 1" if k == p else ""
        joins.append(f"JOIN al a{k} ON a{k}.flow_id = z.flow_id AND a{k}.s = a{k - 1}.t + 1{end}")
        total = f"({total} + a{k}.f)"
    picked = ", ".join(f"a{k}.s AS c{k - 1}" for k in range(2, p + 1))
    order = ", ".join(["f DESC", *[f"{c} ASC" for c in reversed(cuts)]])
    return f"""dv AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY {order}) AS rn
                 FROM (SELECT z.flow_id, {picked}, {total} AS f FROM sz z {" ".join(joins)})) WHERE rn = 1)"""


for _p in (2, 3, 4):
    ORACLES[f"q_marks_p{_p}"] = f"WITH {FUSED}, {_divided(_p)} SELECT flow_id, {', '.join(f'c{k}::BIGINT AS mark_{k}' for k in range(1, _p))} FROM dv"
ORACLES["q_phase_split"] = f"""WITH {FUSED}, {_divided(3)},
ph AS (SELECT tn.*, CASE WHEN c1 IS NULL THEN 1 ELSE 1 + (c1 < pos)::INT + (c2 < pos)::INT END AS phase FROM tn LEFT JOIN dv USING (flow_id))
SELECT flow_id, phase, count(*) AS n, sum(length)::BIGINT AS bytes, min(pos) AS first_pos FROM ph GROUP BY flow_id, phase"""

#: Groups of flow statistics: column to alias.
METER: dict[str, dict[str, str]] = {
    "id": {"Src IP": "src_ip", "Dst IP": "dst_ip", "Src Port": "src_port", "Dst Port": "dst_port", "Protocol": "proto", "Timestamp": "stamp"},
    "duration": {"Flow Duration": "duration", "Flow Bytes/s": "bytes_s", "Flow Packets/s": "packets_s", "Fwd Packets/s": "fwd_s", "Bwd Packets/s": "bwd_s"},
    "counts": {"Total Fwd Packet": "fwd_n", "Total Bwd packets": "bwd_n", "Total Length of Fwd Packet": "fwd_len", "Total Length of Bwd Packet": "bwd_len"},
    "lengths": {f"{side}Packet Length {s}": f"{side.strip().lower() or 'all'}_{s.lower()}" for side in ("Fwd ", "Bwd ", "") for s in ("Max", "Min", "Mean", "Std")} | {"Packet Length Variance": "all_var", "Average Packet Size": "avg_size", "Fwd Segment Size Avg": "fwd_seg", "Bwd Segment Size Avg": "bwd_seg"},
    "iat": {f"{side} IAT {s}": f"{side.lower()}_{s.lower()}" for side in ("Flow", "Fwd", "Bwd") for s in ("Mean", "Std", "Max", "Min")} | {"Fwd IAT Total": "fwd_total", "Bwd IAT Total": "bwd_total"},
    "flags": {f"{f} Flag Count": f.lower() for f in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "CWR", "ECE")} | {f"{s} {f} Flags": f"{s.lower()}_{f.lower()}" for s in ("Fwd", "Bwd") for f in ("PSH", "URG")},
    "ratio": {"Down/Up Ratio": "down_up", "Subflow Fwd Packets": "sub_fwd_n", "Subflow Fwd Bytes": "sub_fwd_len", "Subflow Bwd Packets": "sub_bwd_n", "Subflow Bwd Bytes": "sub_bwd_len"},
    "bulk": {f"{s} {b}": f"{s.lower()}_{a}" for s in ("Fwd", "Bwd") for b, a in (("Bytes/Bulk Avg", "bytes"), ("Packet/Bulk Avg", "packets"), ("Bulk Rate Avg", "rate"))},
    "activity": {f"{k} {s}": f"{k.lower()}_{s.lower()}" for k in ("Active", "Idle") for s in ("Mean", "Std", "Max", "Min")},
}

#: Digits to which a statistic is rounded: microseconds run up to 10^11.
def digits(column: str) -> int:
    return -3 if column.startswith(("Active", "Idle")) or "IAT" in column or column == "Flow Duration" else 6


PREPARED = (
    ASSIGNED
    + r""",
m1 AS (SELECT *, src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w AS fwd, ts_s - lag(ts_s) OVER w AS gs FROM fp WINDOW w AS (PARTITION BY flow_id ORDER BY pkt_no)),
m2 AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY flow_id, fwd ORDER BY pkt_no) AS og, sum(coalesce(gs > 5, false)::INT) OVER w AS ano, sum(coalesce(gs > 1, false)::INT) OVER w AS sno,
              coalesce(lag(fwd) OVER w <> fwd OR gs > 1, false) AS turn FROM m1 WINDOW w AS (PARTITION BY flow_id ORDER BY pkt_no)),
m3 AS (SELECT *, sum(turn::INT) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS rno FROM m2),
m4 AS (SELECT *, count(*) OVER (PARTITION BY flow_id, rno) AS rn, row_number() OVER (PARTITION BY flow_id, rno ORDER BY pkt_no) AS ra,
              CASE WHEN row_number() OVER (PARTITION BY flow_id, ano ORDER BY pkt_no) = 1 THEN (max(ts_s) OVER (PARTITION BY flow_id, ano) - min(ts_s) OVER (PARTITION BY flow_id, ano)) * 1e6 END AS act FROM m3)"""
)


def _meter_sql(name: str) -> str:
    four = lambda x, w: {"Mean": f"avg({x}){w}", "Std": f"stddev_samp({x}){w}", "Max": f"max({x}){w}", "Min": f"min({x}){w}"}
    where = {"Fwd": " FILTER (fwd)", "Bwd": " FILTER (NOT fwd)", "": "", "Flow": ""}
    n = {s: f"count(*){where[s]}::DOUBLE" for s in ("Fwd", "Bwd")}
    size = {s: f"coalesce(sum(length){where[s]}, 0)::DOUBLE" for s in ("Fwd", "Bwd")}
    seconds = "(((max(ts_s) - min(ts_s)) * 1e6) / 1e6)"
    per = lambda x: f"CASE WHEN {seconds} <> 0 THEN ({x}) / {seconds} END"
    ratio = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0 END"
    out = {"Src IP": "arg_min(src_ip, pkt_no)", "Dst IP": "arg_min(dst_ip, pkt_no)", "Src Port": "arg_min(src_port, pkt_no)", "Dst Port": "arg_min(dst_port, pkt_no)", "Protocol": "arg_min(proto, pkt_no)"}
    out["Timestamp"] = "strftime(make_timestamp(floor(min(ts_s) * 1e6)::BIGINT), '%d/%m/%Y %I:%M:%S %p')"
    out |= {"Flow Duration": "(max(ts_s) - min(ts_s)) * 1e6", "Flow Bytes/s": per("sum(length)::DOUBLE"), "Flow Packets/s": per("count(*)::DOUBLE"), "Fwd Packets/s": per(n["Fwd"]), "Bwd Packets/s": per(n["Bwd"])}
    out |= {"Total Fwd Packet": n["Fwd"], "Total Bwd packets": n["Bwd"], "Packet Length Variance": "var_samp(length)", "Average Packet Size": "sum(length)::DOUBLE / count(*)", "Down/Up Ratio": ratio(n["Bwd"], n["Fwd"])}
    for s in ("Fwd", "Bwd", ""):
        out |= {f"{s} Packet Length {k}".strip(): v for k, v in four("length", where[s]).items()}
    for s in ("Flow", "Fwd", "Bwd"):
        gap = "(gs * 1e6)" if s == "Flow" else "(og * 1e6)"
        out |= {f"{s} IAT {k}": v for k, v in four(gap, where[s]).items()}
    for f, bit in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32), ("ECE", 64), ("CWR", 128)):
        out[f"{f} Flag Count"] = f"count_if(coalesce((tcp_flags & {bit}) <> 0, false))::DOUBLE"
    for s in ("Fwd", "Bwd"):
        side = "fwd" if s == "Fwd" else "NOT fwd"
        bulk = f" FILTER ({side} AND rn >= 4)"
        bulks, inside = f"count_if({side} AND rn >= 4 AND ra = 1)::DOUBLE", f"coalesce(sum(gs) FILTER ({side} AND rn >= 4 AND ra > 1), 0)"
        bytes_ = f"coalesce(sum(length){bulk}, 0)::DOUBLE"
        out |= {f"Total Length of {s} Packet": size[s], f"{s} IAT Total": f"coalesce(sum(og * 1e6){where[s]}, 0)", f"{s} Segment Size Avg": ratio(size[s], n[s])}
        out |= {f"Subflow {s} Packets": f"{n[s]} / (max(sno) + 1)", f"Subflow {s} Bytes": f"{size[s]} / (max(sno) + 1)"}
        out |= {f"{s} Bytes/Bulk Avg": ratio(bytes_, bulks), f"{s} Packet/Bulk Avg": ratio(f"count(*){bulk}::DOUBLE", bulks), f"{s} Bulk Rate Avg": ratio(bytes_, inside)}
        for f, bit in (("PSH", 8), ("URG", 32)):
            out[f"{s} {f} Flags"] = f"count_if({side} AND coalesce((tcp_flags & {bit}) <> 0, false))::DOUBLE"
    out |= {f"Active {k}": v for k, v in four("act", "").items()} | {f"Idle {k}": v for k, v in four("(gs * 1e6)", " FILTER (gs > 5)").items()}
    text = ("Src IP", "Dst IP", "Timestamp")
    cols = ", ".join(f"{out[c]} AS {a}" if c in text else f"round(({out[c]})::DOUBLE, {digits(c)}) AS {a}" for c, a in METER[name].items())
    return f"WITH {PREPARED} SELECT flow_id, {cols} FROM m4 GROUP BY flow_id"


_HEADERS = """, h AS (SELECT *, CASE WHEN proto = 6 THEN 20 + pkt_no % 6 * 4 ELSE 8 END AS head, greatest(length - 54, 0) AS load, CASE WHEN proto = 6 THEN pkt_no * 37 % 65536 END AS win FROM m4)"""
_HEADER_COLUMNS = ", ".join(
    f"""coalesce(sum(head) FILTER ({side}), 0)::DOUBLE AS {a}_header, coalesce(min(head) FILTER ({side}), 0)::DOUBLE AS {a}_seg_min, coalesce(arg_min(win, pkt_no) FILTER ({side} AND win IS NOT NULL), 0)::DOUBLE AS {a}_window,
    count_if({side} AND load > 0)::DOUBLE AS {a}_data, coalesce(sum(load) FILTER ({side}), 0)::DOUBLE AS {a}_len, max(load) FILTER ({side})::DOUBLE AS {a}_max"""
    for side, a in (("fwd", "fwd"), ("NOT fwd", "bwd"))
)
ORACLES["q_flowmeter_headers"] = f"WITH {PREPARED}{_HEADERS} SELECT flow_id, {_HEADER_COLUMNS} FROM h GROUP BY flow_id"
ORACLES["q_flowmeter_segments"] = f"""WITH {PREPARED},
k AS (SELECT *, sum(coalesce(gs > 3600, false)::INT) OVER (PARTITION BY flow_id ORDER BY pkt_no) AS meter_no FROM m1)
SELECT flow_id, meter_no, count(*)::DOUBLE AS n, round((max(ts_s) - min(ts_s)) * 1e6, -3) AS duration, arg_min(src_ip, pkt_no) AS src_ip FROM k GROUP BY flow_id, meter_no"""

for _name in METER:
    ORACLES[f"q_flowmeter_{_name}"] = _meter_sql(_name)

ROWS = r"""
rw AS (
  SELECT event_id, ((epoch_us(ts) // 86400000000) // 7 % 4 + 1)::INT AS phase, '10.0.0.' || (user_id % 50) || '-10.1.1.1-' || (user_id % 7 + 1000) || '-80-6' AS k,
         strftime(ts, '%d/%m/%Y %I:%M:%S %p') AS st, floor(epoch_us(ts) / 1e6) AS sec, round(value, 2) AS f0, floor(value) AS f1, floor(value * 2) AS f2, floor(value / 2) AS f3, floor(value * 3) AS f4
  FROM events)"""


def _taken(phases: int, gap: int = 2592000) -> str:
    """Phase after phase: rows that count and the last time that counted."""
    out = f"""{ROWS},
p0 AS (SELECT *, row_number() OVER (PARTITION BY k, phase ORDER BY st, event_id) AS rn, lag(sec) OVER (PARTITION BY k, phase ORDER BY st, event_id) AS prev,
              min(st) OVER (PARTITION BY k) AS smin, max((phase = 1)::INT) OVER (PARTITION BY k) AS has1 FROM rw WHERE phase <= {phases}),
t1 AS (SELECT *, TRUE AS ok FROM p0 WHERE phase = 1),
l1 AS (SELECT k, arg_max(sec, rn) AS last FROM t1 GROUP BY k)"""
    for p in range(2, phases + 1):
        out += f""",
t{p} AS (SELECT * EXCLUDE (good), good = 1 AS ok FROM (
        SELECT p0.*, min((sec - coalesce(prev, last) < {gap})::INT) OVER (PARTITION BY k ORDER BY rn) AS good FROM p0 JOIN l{p - 1} USING (k) WHERE phase = {p})),
l{p} AS (SELECT k, coalesce(m, last) AS last FROM l{p - 1} LEFT JOIN (SELECT k, arg_max(sec, rn) AS m FROM t{p} WHERE ok GROUP BY k) USING (k))"""
    every = " UNION ALL ".join(f"SELECT * FROM t{p} WHERE ok" for p in range(1, phases + 1))
    return f"{out},\ntk AS ({every})"


ORACLES["q_concat_takewhile"] = f"WITH {_taken(4)} SELECT event_id, phase, rn FROM tk"
_HOW = ("max", "sum", "sum", "min", "avg")
ORACLES["q_concat_agg"] = f"""WITH {_taken(2)},
g AS (SELECT k, phase, min(smin) AS ts, {", ".join(f"{h}(f{i}) AS f{i}" for i, h in enumerate(_HOW))} FROM tk GROUP BY k, phase)
SELECT a.k AS flow_key, a.ts, {", ".join(f"round(a.f{i}, 6) AS f{i}_p1, round(coalesce(b.f{i}, a.f{i}), 6) AS f{i}_p2" for i in range(5))}
FROM (SELECT * FROM g WHERE phase = 1) a LEFT JOIN (SELECT * FROM g WHERE phase = 2) b USING (k)"""
ORACLES["q_concat_carry"] = f"""WITH {_taken(4, 172800)},
g AS (SELECT k, phase, sum(f1) AS v FROM tk GROUP BY k, phase),
h AS (SELECT k, max(v) FILTER (phase = 1) AS a, max(v) FILTER (phase = 2) AS b, max(v) FILTER (phase = 3) AS c, max(v) FILTER (phase = 4) AS d FROM g GROUP BY k)
SELECT k AS flow_key, round(a, 6) AS p1, round(coalesce(b, a), 6) AS p2, round(coalesce(c, b, a), 6) AS p3, round(coalesce(d, c, b, a), 6) AS p4 FROM h"""


def _orders(cases: str, start: str = "date_trunc('second', o_orderdate)") -> str:
    return f"""WITH o AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN '10.0.0.1' WHEN 'O' THEN '10.0.0.2' ELSE '10.0.0.3' END AS src, o_custkey % 5 + 80 AS dport,
         CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 5 + 80 END AS mp, o_orderkey % 3 AS flen, o_orderkey % 2 AS rst, o_orderkey % 17 AS fn,
         floor(o_totalprice * 1000) / 1e6 AS dur, {start} AS fs FROM orders),
f AS (SELECT *, fs + to_microseconds(round(dur * 1e6)::BIGINT) AS fe FROM o)
SELECT o_orderkey, CASE {cases} ELSE 'BENIGN' END AS label FROM f"""


_A, _B = "WHEN src = '10.0.0.1' THEN 'A'", "WHEN dport IN (81, 82, 83) THEN 'B'"
_C, _Z = "WHEN dport = 82 AND flen = 0 THEN 'C'", "WHEN src = '10.0.0.3' AND fn > 12 THEN 'Z'"
ORACLES["q_label_order"] = _orders(f"{_Z} {_C} {_B} {_A}")
ORACLES["q_label_first"] = _orders(f"{_A} {_B} {_C} {_Z}")
ORACLES["q_label_ops"] = _orders("""WHEN dur < 40 THEN 'lt' WHEN contains(o_orderpriority, 'LOW') AND mp IS NOT NULL THEN 'text' WHEN mp IS NULL AND fn <= 3 THEN 'null'
  WHEN (mp IS NULL OR mp NOT IN (80, 81, 82)) AND rst >= 1 THEN 'notin' WHEN (mp IS NULL OR mp <> 80) AND regexp_matches(o_orderpriority, '^[12]') THEN 'ne'""")
_BETWEEN = "NOT coalesce(fe < TIMESTAMP '{0}', false) AND NOT coalesce(fs > TIMESTAMP '{1}', false)"
_STRICT = "coalesce(fe >= TIMESTAMP '{0}' AND fs <= TIMESTAMP '{1}', false)"


def _times(between: str) -> str:
    w = between.format
    return f"""WHEN {w("1993-01-01", "1993-03-01")} THEN 'three'
  WHEN src = '10.0.0.2' AND (({w("1996-01-01", "1996-06-30")}) OR ({w("1997-01-01", "1997-02-01")})) THEN 'two' WHEN {w("1994-03-01", "1995-02-28 12:00:00")} THEN 'one'"""


_BAD = "CASE WHEN o_orderkey % 13 <> 0 THEN date_trunc('second', o_orderdate) END"
ORACLES["q_label_time"] = _orders(_times(_BETWEEN))
ORACLES["q_label_null_ts"] = _orders(_times(_BETWEEN), _BAD)
ORACLES["q_label_strict_ts"] = _orders(_times(_STRICT), _BAD)
_HALIFAX = """WHEN NOT coalesce(fe < TIMESTAMP '1992-12-31 20:00:00', false) AND NOT coalesce(fs > TIMESTAMP '1993-02-28 20:00:00', false) THEN 'three'
  WHEN src = '10.0.0.2' AND ((NOT coalesce(fe < TIMESTAMP '1995-12-31 20:00:00', false) AND NOT coalesce(fs > TIMESTAMP '1996-06-29 21:00:00', false))
                          OR (NOT coalesce(fe < TIMESTAMP '1996-12-31 20:00:00', false) AND NOT coalesce(fs > TIMESTAMP '1997-01-31 20:00:00', false))) THEN 'two'
  WHEN NOT coalesce(fe < TIMESTAMP '1994-02-28 20:00:00', false) AND NOT coalesce(fs > TIMESTAMP '1995-02-28 08:00:00', false) THEN 'one'"""
ORACLES["q_label_zone"] = _orders(_HALIFAX)
ORACLES["q_label_fields"] = _orders("WHEN o_orderkey % 4 = 3 AND dur >= 100 THEN 'large' WHEN o_orderkey % 4 = 0 AND flen >= 1 THEN 'silent' WHEN dur < 60 THEN 'short'")
ORACLES["q_label_nested"] = _orders("WHEN dport = 84 AND flen = 0 THEN 'both' WHEN src = '10.0.0.1' AND (dport = 80 OR (fn > 5 AND rst = 1)) THEN 'nest'")

TOTALS = """WITH g AS (SELECT l_orderkey, count_if(l_returnflag = 'N') + count_if(l_returnflag = 'A') AS x FROM lineitem GROUP BY l_orderkey), t AS (SELECT x::BIGINT AS x FROM g WHERE x > 0)"""
ORACLES["q_dist_stats"] = f"""{TOTALS} SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS std, min(x) AS least, max(x) AS most,
  round(count_if(x > 2) * 100.0::DOUBLE / count(*), 6) AS pct_above_2, round(count_if(x > 4) * 100.0::DOUBLE / count(*), 6) AS pct_above_4 FROM t"""
_LEVELS = "[0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]"
ORACLES["q_dist_quantiles"] = f"""{TOTALS}, q AS (SELECT quantile_cont(x::DOUBLE, {_LEVELS}) AS v FROM t)
SELECT unnest({_LEVELS})::DOUBLE AS q, round(unnest(v), 6) AS value FROM q"""
ORACLES["q_dist_hist"] = f"""{TOTALS}, s AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi, (max(x)::DOUBLE - min(x)::DOUBLE) / 50 AS w FROM t),
b AS (SELECT least(floor((x - lo) / w) + 1, 50)::INT AS bin, count(*) AS n FROM t, s GROUP BY ALL)
SELECT i::INT AS bin, coalesce(n, 0) AS n, round(lo + (i - 1) * w, 6) AS low, round(lo + i * w, 6) AS high FROM s, range(1, 51) AS r(i) LEFT JOIN b ON i = bin"""
ORACLES["q_flow_counts_fin"] = f"""WITH {PACKETS},
e AS (SELECT *, coalesce(lag(is_fin) OVER (PARTITION BY endpoint_key ORDER BY pkt_no), false)::INT AS ended FROM pkk WHERE proto IN (6, 17)),
p AS (SELECT *, sum(ended) OVER (PARTITION BY endpoint_key ORDER BY pkt_no)::INT AS part FROM e),
g AS (SELECT endpoint_key, part, count(*) AS n, max(is_fin::INT) = 1 AS ended, arg_max(ts_s, pkt_no) - arg_min(ts_s, pkt_no) AS lasted FROM p GROUP BY endpoint_key, part)
SELECT endpoint_key, part, n, ended FROM g WHERE ended OR lasted <= 2592000"""
