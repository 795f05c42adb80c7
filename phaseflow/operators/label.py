"""Rule-based labels: a rule set becomes one CASE expression.

Rules are tried in ascending priority and the last match wins (``policy="first"``: the first one). A condition reads a
column, or else a derived field; nulls behave as they do in column masks: ``!=`` and ``not_in`` hold for null, the other
comparisons do not. A flow without a readable start overlaps every time window unless ``strict_time`` is set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "dd/MM/yyyy hh:mm:ss a"
TIME_FIELDS = ("time_start", "time_end", "time_window")


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def load_rules(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def with_endpoints(wide: DataFrame, mask: Sequence[str] = (), stamp: str = "Timestamp", time_format: str = TIME_FORMAT, duration: str = "Flow Duration_p1") -> DataFrame:
    """Adds endpoints, flow_start, flow_duration_s and flow_end; drops masked columns, never the time stamp."""
    df = wide.drop(*[c for c in mask if c != stamp])
    part = F.split("Flow Key", "-")
    df = df.withColumns({"src_ip": part[0], "dst_ip": part[1], "src_port": part[2].cast("int"), "dst_port": part[3].cast("int"), "proto": part[4]})
    df = df.withColumn("flow_start", F.try_to_timestamp(F.col(stamp), F.lit(time_format)))
    df = df.withColumn("flow_duration_s", F.col(f"`{duration}`").cast("double") / 1e6)
    micros = F.unix_micros("flow_start") + F.round(F.col("flow_duration_s") * 1e6).cast("long")
    return df.withColumn("flow_end", F.timestamp_micros(micros))


def _derived(field: str) -> Column | None:
    phase1 = lambda c: F.col(f"`{c}_p1`")
    if field in ("zero_fwd", "zero_bwd"):
        return phase1(f"Total Length of {'Fwd' if field == 'zero_fwd' else 'Bwd'} Packet") == 0
    if field == "flow_duration":
        return phase1("Flow Duration") / 1e6
    names = {"fwd_rst_flags": "RST Flag Count", "bwd_rst_flags": "RST Flag Count", "total_fwd_pkts": "Total Fwd Packet", "total_fwd_len": "Total Length of Fwd Packet", "total_bwd_len": "Total Length of Bwd Packet"}
    return phase1(names[field]) if field in names else None


class Compiler:
    """Conditions over the columns of one frame."""

    def __init__(self, schema: T.StructType, shift: timedelta = timedelta(0), strict_time: bool = False, zone: str | None = None):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.shift, self.strict_time = shift, strict_time
        self.zone = ZoneInfo(zone) if zone else None

    def moved(self, time: Any, shift: timedelta | None) -> str:
        """A rule's time as flows have it: shifted, and from UTC to the zone; as it is without ``shift``."""
        t = datetime.fromisoformat(str(time))
        if shift is not None:
            t += shift
            if self.zone:
                t = t.replace(tzinfo=UTC).astimezone(self.zone).replace(tzinfo=None)
        return t.isoformat(sep=" ")

    def field(self, name: str) -> tuple[Column, T.DataType | None]:
        if name in self.types:
            return F.col(f"`{name}`"), self.types[name]
        if (found := _derived(name)) is None:
            raise RuleError(f"unknown field: {name}")
        return found, T.BooleanType() if name.startswith("zero_") else T.DoubleType()

    def comparison(self, name: str, op: str, value: Any) -> Column:
        c, kind = self.field(name)
        real = isinstance(kind, T.FloatType | T.DoubleType)
        values = value if isinstance(value, list | tuple) else [value]
        if isinstance(kind, T.StringType):
            values = [str(v) for v in values]
        elif not isinstance(kind, T.BooleanType):  # a number never equals text
            values = [v for v in values if not isinstance(v, str)]
        any_of = lambda: c.isin(values) if values else F.lit(False)
        known = (lambda x: x & ~F.isnan(c)) if real else (lambda x: x)
        no = F.lit(False)
        match op:
            case "==" | "in":
                return F.coalesce(any_of(), no)
            case "!=" | "not_in":
                return F.coalesce(~any_of(), F.lit(True))
            case ">" | ">=" | "<" | "<=":
                if not values:
                    raise RuleError(f"{name} {op}: not a number")
                v = values[0]
                return F.coalesce(known({">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]), no)
            case "contains":
                return F.coalesce(c.cast("string").rlike(str(value)), no)
            case "regex":
                return F.coalesce(c.cast("string").rlike(f"^(?:{value})"), no)
            case "isnull":
                return c.isNull() | F.isnan(c) if real else c.isNull()
            case "notnull":
                return c.isNotNull() & ~F.isnan(c) if real else c.isNotNull()
        raise RuleError(f"unknown operator: {op}")

    def overlap(self, begin: str, end: str, shift: timedelta | None) -> Column:
        lo, hi = (F.lit(self.moved(t, shift)).cast("timestamp") for t in (begin, end))
        if self.strict_time:
            return F.coalesce((F.col("flow_end") >= lo) & (F.col("flow_start") <= hi), F.lit(False))
        return ~F.coalesce(F.col("flow_end") < lo, F.lit(False)) & ~F.coalesce(F.col("flow_start") > hi, F.lit(False))

    def all_of(self, conditions: Sequence[Mapping[str, Any]], shift: timedelta | None) -> Column:
        parts, begin, end, ranges = [], None, None, []
        for c in conditions:
            name, value = c["field"], c["value"]
            if name == "any":
                if value is not True:
                    raise RuleError("field any takes the value true only")
            elif name == "any_ip":
                ips = value if isinstance(value, list) else [value]
                parts.append(F.coalesce(F.col("src_ip").isin(ips), F.lit(False)) | F.coalesce(F.col("dst_ip").isin(ips), F.lit(False)))
            elif name == "time_start":
                begin = value
            elif name == "time_end":
                end = value
            elif name == "time_window":
                if c.get("op") == "range":
                    begin, end = value
                elif c.get("op") == "ranges":
                    ranges = value
                else:
                    raise RuleError(f"time_window takes range or ranges, not {c.get('op')}")
            else:
                parts.append(self.comparison(name, c.get("op", "=="), value))
        if begin is not None and end is not None:
            parts.append(self.overlap(begin, end, shift))
        elif ranges:
            parts.append(reduce(lambda a, b: a | b, [self.overlap(x, y, shift) for x, y in ranges]))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def logic(self, node: Mapping[str, Any]) -> Column:
        if "any_of" in node:
            return reduce(lambda a, b: a | b, [self.nested(x) for x in node["any_of"]], F.lit(False))
        if "all_of" in node:
            return reduce(lambda a, b: a & b, [self.nested(x) for x in node["all_of"]], F.lit(True))
        if "field" in node:
            return self.all_of([node], None)
        raise RuleError(f"unknown logic: {sorted(node)}")

    def nested(self, node: Any) -> Column:
        """Conditions inside logic; their times are not moved."""
        return self.all_of(node, None) if isinstance(node, list) else self.logic(node)

    def rule(self, rule: Mapping[str, Any]) -> Column:
        out = self.all_of(rule.get("match") or [], self.shift)
        extra = rule.get("extra_logic")
        return out & self.logic(extra) if extra else out


def label_column(schema: T.StructType, rules: Mapping[str, Any], policy: str = "last", shift: timedelta = timedelta(0), strict_time: bool = False, zone: str | None = None) -> Column:
    """The label of a row; ``zone`` names the time zone of the flows' stamps where the rules' times are in UTC."""
    compiler = Compiler(schema, shift, strict_time, zone)
    ordered = sorted(rules.get("rules") or [], key=lambda r: r.get("priority", float("inf")))
    if policy == "first":
        ordered = ordered[::-1]
    out = F.lit((rules.get("meta") or {}).get("default_label", "BENIGN"))
    for r in ordered:  # each later rule is tried before what stands already
        out = F.when(compiler.rule(r), F.lit(r["label"])).otherwise(out)
    return out


def labelled(flows: DataFrame, rules: Mapping[str, Any], **options: Any) -> DataFrame:
    """``flows`` (of :func:`with_endpoints`) with ``Label``."""
    return flows.withColumn("Label", label_column(flows.schema, rules, **options))
