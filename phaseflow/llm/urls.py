"""URL filters: host and path rules, and redirect equivalence.

Rules judge a url by host (with subdomains) and path prefix; the longest rule that fits wins. Pages without a rule of
their own take part in equivalence: a page's html names other addresses of it (a canonical link, or a meta refresh,
which is a redirect), these edges join addresses into components, found distributed, and a component with a blocked
page blocks its members. Explicit allow has precedence: an allow rule on a page itself wins over any alias, and a
component that holds an explicitly allowed page blocks none of its members but those with a block rule of their own.
Pages that nothing decides get ``default``.

An address is a url without scheme and fragment, with the ASCII letters of the host lower-cased.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no address, so nothing
links to it; null html has no links; links that are neither absolute nor rooted at ``/`` are left alone; repeated rows
are judged alike; an empty table gives an empty result. Rules are a list that the driver holds. Plain DataFrame
operations only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseflow.llm.components import components
from phaseflow.llm.scratch import written

LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; ``verdict`` is allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(F.substr(url, F.locate("://", url) + 3), r"^[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(host != "", F.concat(host, rest))


def _first_match(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "allow"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _targets(url: Column, html: Column) -> Column:
    """Addresses that the html names as the page's own: array of strings, maybe empty."""
    some = F.coalesce(html.rlike(r"(?i)canonical|http-equiv"), F.lit(False))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    metas = F.transform(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH, 1))
    root = F.regexp_extract(url, r"^.*?://[^/?#]*", 0)
    whole = lambda t: address(F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(root, t)).otherwise(t))
    found = F.filter(F.transform(F.concat(links, metas), whole), lambda t: t.isNotNull())
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def judged(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", keep: Sequence[str] = ("page_id",), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule`` (null: none fits), ``verdict`` and ``component`` (null: no alias)."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(*keep, host.alias("host"), path.alias("path"), address(url).alias("__node"), _targets(url, F.col(html_col)).alias("__to"))
    rows = rows.withColumn("__own", _first_match(rules, F.col("host"), F.col("path")))
    rows = written(rows.select(*keep, "host", "path", "__node", "__to", F.col("__own.rule").alias("rule"), F.col("__own.verdict").alias("__verdict")), "urls")
    edges = rows.filter((F.size("__to") > 0) & F.col("__node").isNotNull()).select(F.col("__node").alias("a"), F.explode("__to").alias("b"))
    member = written(components(edges).withColumnRenamed("node", "__node"), "urls-members")
    ruled = rows.filter(F.col("__verdict").isNotNull()).groupBy("__node").agg(F.max(F.col("__verdict") == "allow").alias("allows"))
    ruled = written(ruled, "urls-ruled").join(member, "__node")
    of_component = ruled.groupBy("component").agg(F.when(F.max("allows"), F.lit("allow")).otherwise(F.lit("block")).alias("__spread"))
    spread = written(member.join(of_component, "component", "left"), "urls-spread")
    out = rows.drop("__to").join(spread, "__node", "left")
    verdict = F.coalesce(F.col("__verdict"), F.col("__spread"), F.lit(default))
    return out.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "component")
