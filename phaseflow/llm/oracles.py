"""DuckDB SQL for the queries of this subpackage."""

from phaseflow.llm import licenses, quality

SQL: dict[str, str] = {}

SQL["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
c AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 4)) END AS cls FROM d),
k AS (SELECT sn, s, cls, ceil(sqrt(count(*)))::BIGINT AS parts FROM c GROUP BY ALL),
b AS (SELECT c.*, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT) % parts AS blk FROM c JOIN k USING (sn, s, cls)),
r AS (SELECT *, row_number() OVER (PARTITION BY sn, s ORDER BY cls, blk, doc_id, size) AS rnk FROM b),
t AS (SELECT sn, s, sum(size)::BIGINT AS total FROM d GROUP BY ALL),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY sn, s) - 1) % 3) + 1]::BIGINT AS w, total * 3 AS cap FROM t),
x AS (SELECT *, cap / w::DOUBLE AS rho FROM w),
y AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY rho, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / (sum(w) OVER (ORDER BY rho, sn, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM x),
z AS (SELECT lvl AS lv FROM y WHERE rho > lvl ORDER BY rho, sn, s LIMIT 1),
g AS (SELECT sn, s, total, least(cap::DOUBLE, w::DOUBLE * coalesce((SELECT lv FROM z), 0.0)) AS target,
             (('0x' || substr(md5('mix-1:' || sn::VARCHAR || ':' || s), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS u FROM y)
SELECT doc_id, size, total AS source_size, target,
       ((floor(rnk * (CASE WHEN total > 0 THEN target / total ELSE 0 END) + u)
         - floor((rnk - 1) * (CASE WHEN total > 0 THEN target / total ELSE 0 END) + u)) * size)::BIGINT AS taken
FROM r JOIN g USING (sn, s)
"""

SQL["op6_urls"] = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest,
         regexp_extract(url, '^.*?://[^/?#]*', 0) AS root
  FROM pages),
p AS (
  SELECT page_id, html, root, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM u),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN tail = '' THEN '/' ELSE tail END END AS node FROM p),
rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (
  SELECT n.page_id, n.host, n.path, n.node, n.html, n.root, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS own
  FROM n LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL),
f AS (
  SELECT node, root, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS t
  FROM j WHERE node IS NOT NULL),
g AS (SELECT node, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN root || t ELSE t END AS t FROM f),
k AS (SELECT node, substr(t, strpos(t, '://') + 3) AS rest FROM g WHERE contains(t, '://')),
e AS (
  SELECT node AS a, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || CASE WHEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS b
  FROM k WHERE regexp_extract(rest, '^[^/?#]*', 0) <> ''),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
w AS (SELECT r.a AS node, CASE WHEN bool_or(j.own = 'allow') THEN 'allow' WHEN bool_or(j.own = 'block') THEN 'block' END AS spread
      FROM r JOIN j ON j.node = r.b GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(own, spread, 'allow') AS verdict FROM j LEFT JOIN w USING (node)
"""


def _canonical(text: str) -> str:
    """List of a text's lines in canonical form."""
    form = "' ' || trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', '  ', 'g')) || ' '"
    for a, b in licenses.EQUAL:
        form = f"replace({form}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    form = f"replace({form}, '  ', ' ')"
    low = f"translate(replace(coalesce({text}, ''), chr(13), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lines = f"list_filter(string_split({low}, chr(10)), lambda x: NOT regexp_matches(x, '{licenses.COPYRIGHT}'))"
    return f"list_filter(list_transform({lines}, lambda x: trim({form})), lambda x: x <> '')"


_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.known())
SQL["op9_licenses"] = f"""
WITH given(license, text) AS (VALUES {_KNOWN}),
known AS (SELECT array_to_string({_canonical("text")}, ' ') AS form, min(license) AS license FROM given GROUP BY 1),
d AS (SELECT doc_id, {_canonical("text")} AS lines FROM documents),
u AS (SELECT doc_id, -1 AS at_, array_to_string(lines, ' ') AS form FROM d
      UNION ALL SELECT doc_id, i, lines[i] FROM d, unnest(range(1, len(lines) + 1)) AS r(i)),
h AS (SELECT doc_id, at_, license FROM u JOIN known USING (form))
SELECT doc_id, min(license) FILTER (at_ = -1) AS text_license, count(DISTINCT at_) FILTER (at_ >= 0) AS n_notices,
       coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (at_ >= 0), '') AS notices
FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN h USING (doc_id) GROUP BY doc_id
"""

SQL["op1_suffixes"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS r(i)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s),
c AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE lo < doc_id),
n AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT r.doc_id, run, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1,
                                         2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece FROM r JOIN d USING (doc_id)),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, string_agg(piece, '' ORDER BY a) AS head FROM k GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

SQL["op2_caps"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v
       WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN l USING (vec_id)
"""


def _outliers() -> str:
    """The base rules and the determinant's steps, written out."""
    d, pairs, floors = quality.D, quality.PAIRS, quality.FLOORS
    x = ["ln(1 + n_words)", "ln(word_chars / n_words)", "ln(1 + n_symbols / n_words)", "n_dup_lines / greatest(n_lines, 1)", "n_repeat_words / n_words"]
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda z: z <> '')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]'))"
    out = f"""WITH t AS (SELECT doc_id, lang IS NULL AS ln, coalesce(lang, '') AS lg, source IS NULL AS sn, coalesce(source, '') AS sr, {words} AS w, {lines} AS ls,
  len(regexp_extract_all(coalesce(text, ''), '[{quality.SYMBOLS}]')) AS n_symbols FROM documents),
g AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
e AS (SELECT doc_id, i, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM h WHERE c > 1),
f AS (SELECT doc_id, sum(k) AS k FROM e GROUP BY doc_id),
b AS (SELECT doc_id, ln, lg, sn, sr, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::BIGINT AS word_chars, n_symbols, len(ls) AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN f USING (doc_id)),
j AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
x AS MATERIALIZED (SELECT ln, lg, sn, sr, doc_id, {", ".join(f"({c})::DOUBLE AS x{i}" for i, c in enumerate(x))} FROM j WHERE NOT base_failed)"""
    key = "ln, lg, sn, sr"
    quant = lambda i, q: f"list_sort(list(floor(x{i} * 64)))[ceil({q} * count(*))::BIGINT]"
    first = [f"({quant(i, 0.5)} + 0.5) / 64 AS m{i}" for i in range(d)]
    first += [f"((({quant(i, 0.75)} + 1) / 64 - {quant(i, 0.25)} / 64) / 1.349) ** 2 AS c{i}_{i}" if i == k else f"0.0::DOUBLE AS c{i}_{k}" for i, k in pairs]
    out += f", p0 AS (SELECT {key}, 0 AS st, {', '.join(first)} FROM x GROUP BY {key})"
    names = ", ".join([*(f"m{i}" for i in range(d)), *(f"l{i}_{j}" for i, j in pairs)])

    def factor(k: str) -> str:
        """Cholesky factors, one CTE each as later ones need earlier ones."""
        floored = ", ".join(f"greatest(c{i}_{i}, {floors[i] ** 2!r}::DOUBLE) AS c{i}_{i}" for i in range(d))
        sql, last = f", b{k} AS (SELECT * REPLACE ({floored}) FROM p{k})", f"b{k}"
        for i, j in pairs:
            rest = " - ".join([f"c{i}_{j}", *[f"l{i}_{z} * l{j}_{z}" for z in range(j)]])
            name = f"f{k}_{i}{j}"
            sql += f", {name} AS (SELECT *, {f'sqrt(greatest({rest}, {quality.LEAST!r}::DOUBLE))' if i == j else f'({rest}) / l{j}_{j}'} AS l{i}_{j} FROM {last})"
            last = name
        return sql + f", o{k} AS MATERIALIZED (SELECT {key}, st, {names}, 2 * ({' + '.join(f'ln(l{i}_{i})' for i in range(d))}) AS logdet FROM {last})"

    def distances(k: str) -> str:
        """Forward substitution."""
        sql, last = f", y{k}_ AS (SELECT x.*, st, {names} FROM x JOIN o{k} USING ({key}))", f"y{k}_"
        for i in range(d):
            rest = " - ".join([f"x{i} - m{i}", *[f"l{i}_{z} * y{z}" for z in range(i)]])
            sql += f", y{k}_{i} AS (SELECT *, ({rest}) / l{i}_{i} AS y{i} FROM {last})"
            last = f"y{k}_{i}"
        return sql + f", d{k} AS MATERIALIZED (SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(d))} AS d2 FROM {last})"

    means = [f"avg(x{i}) AS m{i}" for i in range(d)]
    cov = lambda f: [f"(avg(x{i} * x{j}) - avg(x{i}) * avg(x{j})) * {f} AS c{i}_{j}" for i, j in pairs]
    out += factor("0")
    for k in range(quality.STEPS):
        out += distances(str(k))
        out += f", n{k} AS (SELECT *, floor(log2(d2 + 1e-6) * 8) AS bin FROM d{k}), q{k} AS (SELECT {key}, st, list_sort(list(bin))[ceil({quality.SUBSET} * count(*))::BIGINT] AS cut FROM n{k} GROUP BY {key}, st)"
        step = f"SELECT {key}, st, {', '.join([*means, *cov(quality.CONSISTENT)])} FROM n{k} JOIN q{k} USING ({key}, st) WHERE bin <= cut GROUP BY {key}, st"
        if k == 0:
            sign = [f"any_value(m{i})" for i in range(d)] + [f"coalesce(sum(y{i} * y{j} / nullif(d2, 0)), 0) / count(*) * {d} * any_value(l{i}_{i}) * any_value(l{j}_{j})" for i, j in pairs]
            step += f" UNION ALL SELECT {key}, 1, {', '.join([*means, *cov(1.0)])} FROM x GROUP BY {key} UNION ALL SELECT {key}, 2, {', '.join(sign)} FROM d0 GROUP BY {key}"
        out += f", p{k + 1} AS ({step}){factor(str(k + 1))}"
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM o{k + 1}" for k in range(quality.STEPS))
    out += f", o AS (SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(logdet, 6), k, st) AS rank FROM ({every})) WHERE rank = 1)"
    out += distances("")
    return f"""{out}
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {quality.CUT}, false) AS kept, n_lines, round(d2, 4) AS d2
FROM j LEFT JOIN (SELECT doc_id, d2 FROM d) USING (doc_id)"""


SQL["op10_quality"] = _outliers()
