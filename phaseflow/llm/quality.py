"""Quality rules: base rules on whole texts, then robust multivariate outliers per language and source.

Base statistics come from one scan with native array expressions. Rows that pass the base rules are turned into a
vector of five transformed statistics; for each (language, source) the centre and scatter of the vectors are estimated
by minimum covariance determinant and rows whose squared Mahalanobis distance exceeds ``CUT`` are rejected.

The determinant is minimised by concentration steps: distances under the present estimate, the ``SUBSET`` nearest part
of the group, and its mean and covariance. A step is one aggregation: moments are summed per group and bin of distance,
so the nearest part is a running sum over at most some hundred bins, no rows are sorted, and a group with a third of
all rows is summed up map-side like any other. As steps end in local minima, each group has three starts that do not
depend on chance: the median and the interquartile ranges (from binned counts), the mean and covariance of all rows, and
the median with the covariance of spatial signs. All take their steps together, ``STEPS`` of them or until no determinant
changes, and of all estimates on the way that of the least determinant counts.

``FLOORS`` is the resolution of each statistic: the least deviation that an estimate can have, so that a group of copies
(no variance at all) does not reject whatever differs from them. Every statistic alone can reject a row.

Cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of their own; a
group of one row keeps it; an empty table gives an empty result; extra columns stay out of the result but for
``keep``. Windows of words are compared by 64-bit hashes within one text. Plain DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseflow.llm.scratch import written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: ln(1 + words), ln(characters a word), ln(1 + symbols a word), repeated lines a line, repeated words a word.
FLOORS = (0.5, 0.15, 0.06, 0.1, 0.035)
#: Part of a group that a concentration step keeps, and the factor that makes its covariance consistent for a normal
#: distribution of five dimensions: SUBSET / P(chi2 with 7 degrees <= q), q the SUBSET quantile of chi2 with 5.
SUBSET = 0.75
CONSISTENT = 1.41
#: The 0.9999 quantile of chi2 with 5 degrees of freedom.
CUT = 25.74
#: What a pivot of a factorization has at least; rounding may make it negative where statistics depend on each other.
LEAST = 1e-6
#: Steps at most, and change of a determinant's logarithm that counts as none.
STEPS, STILL = 6, 1e-9

D = len(FLOORS)
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
G, START = "__group", "__start"
MEANS, FACTOR = [f"m{i}" for i in range(D)], [f"l{i}_{j}" for i, j in PAIRS]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words that windows at the sorted distinct ``starts`` cover together."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that the text has more than once."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(of_windows(g)))

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
            return let(starts, _covered)

        return let(ordered, twins)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def _of_words(words: Column) -> Column:
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w))
    return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), _repeated(words).alias("n_repeat_words"))


def _of_lines(lines: Column) -> Column:
    n = F.size(lines).cast("long")
    return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """Base statistics and ``base_failed`` of each row; columns of ``keep`` come first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = let(F.filter(F.split(text, BLANK), lambda w: w != ""), _of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _of_lines)
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")
    out = docs.select(*keep, words.alias("__w"), lines.alias("__l"), symbols.alias("n_symbols"))
    out = out.select(*keep, "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def vectors(stats: DataFrame) -> DataFrame:
    words = F.col("n_words").cast("double")
    x = [F.log1p(words), F.log(F.col("word_chars") / words), F.log1p(F.col("n_symbols") / words), F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words]
    return stats.withColumns(dict(zip(X, (F.when(~F.col("base_failed"), c.cast("double")) for c in x), strict=True)))


def _first_estimate(points: DataFrame) -> DataFrame:
    """Median and interquartile range per group and statistic, from counts in bins of a 64th."""
    wide = points.select(G, F.posexplode(F.array(*X)).alias("dim", "x")).select(G, "dim", F.floor(F.col("x") * 64).alias("bin"))
    counts = written(wide.groupBy(G, "dim", "bin").agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    w = Window.partitionBy(G, "dim")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    spread = run.groupBy(G).agg(*[f for i in range(D) for f in (
        F.min(F.when((F.col("dim") == i) & (F.col("upto") >= F.col("all") * 0.5), (F.col("bin") + 0.5) / 64)).alias(f"m{i}"),
        F.min(F.when((F.col("dim") == i) & (F.col("upto") >= F.col("all") * 0.25), F.col("bin") / 64)).alias(f"lo{i}"),
        F.min(F.when((F.col("dim") == i) & (F.col("upto") >= F.col("all") * 0.75), (F.col("bin") + 1) / 64)).alias(f"hi{i}"),
    )])
    cov = [(F.pow((F.col(f"hi{i}") - F.col(f"lo{i}")) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS]
    return spread.select(G, F.lit(0).alias(START), *MEANS, *cov)


def _factor(estimate: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance with its floors, written out, and the logarithm of its determinant."""
    estimate = estimate.withColumns({f"c{i}_{i}": F.greatest(F.col(f"c{i}_{i}"), F.lit(FLOORS[i] ** 2)) for i in range(D)})
    for i, j in PAIRS:
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        estimate = estimate.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(LEAST))) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = sum((F.log(F.col(f"l{i}_{i}")) for i in range(1, D)), F.log(F.col("l0_0"))) * 2
    return estimate.select(G, START, *MEANS, *FACTOR, logdet.alias("logdet"))


def _whitened(points: DataFrame, factor: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``start``, the whitened statistics ``y0``, ``y1``, ... and the squared Mahalanobis distance ``d2``."""
    out = points.join(factor, G, how)
    for i in range(D):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*points.columns, START, *[f"y{i}" for i in range(D)], "d2")


MOMENTS = ["n", *[f"s{i}" for i in range(D)], *[f"q{i}_{j}" for i, j in PAIRS]]


def _moments(points: DataFrame, factor: DataFrame, signs: bool = False) -> DataFrame:
    """Count, sums and sums of products per group, start and bin of distance; with ``signs`` those of spatial signs."""
    near = _whitened(points, factor).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-6) * 8))
    sums = [F.count(F.lit(1)), *[F.sum(x) for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS]]
    sums = [c.alias(n) for c, n in zip(sums, MOMENTS, strict=True)]
    if signs:
        sums += [F.sum(F.try_divide(F.col(f"y{i}") * F.col(f"y{j}"), F.col("d2"))).alias(f"r{i}_{j}") for i, j in PAIRS]
    return written(near.groupBy(G, START, "bin").agg(*sums), "quality-bins")  # dealt by bin, so no task sums up a whole group


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Mean, and covariance times ``factor``, from moments."""
    sums = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(D)})
    cov = [((F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(f"c{i}_{j}") for i, j in PAIRS]
    return sums.select(G, START, *MEANS, *cov)


def _nearest(bins: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest part under each estimate: one concentration step."""
    w = Window.partitionBy(G, START)
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    inner = bins.filter(F.col("upto") - F.col("n") < F.col("all") * SUBSET)
    return _estimate(inner.groupBy(G, START).agg(*[F.sum(c).alias(c) for c in MOMENTS]), CONSISTENT)


def _starts(bins: DataFrame, first: DataFrame) -> DataFrame:
    """One step of the first start, and the two others: the moments under the first start hold them all."""
    signs = [f"r{i}_{j}" for i, j in PAIRS]
    total = bins.groupBy(G).agg(*[F.sum(c).alias(c) for c in [*MOMENTS, *signs]])
    every = _estimate(total.withColumn(START, F.lit(1)), 1.0)
    sign = total.join(first, G)
    cov = [(F.coalesce(F.col(f"r{i}_{j}"), F.lit(0.0)) / F.col("n") * D * F.col(f"l{i}_{i}") * F.col(f"l{j}_{j}")).alias(f"c{i}_{j}") for i, j in PAIRS]
    return _nearest(bins).union(every).union(sign.select(G, F.lit(2).alias(START), *MEANS, *cov))


def least_determinant(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """(group, start, means, factor, logdet): the estimate of the least determinant for each group of ``points``."""
    small = lambda df, k: written(_factor(df).repartition(1), f"quality-{k}")  # noqa: E731  a row a group and start in one file, so that its size shows
    first = small(_first_estimate(points), "first")
    now = small(_starts(_moments(points, first, signs=True), first), 0)
    found = [now]
    for k in range(1, steps):
        now = small(_nearest(_moments(points, now)), k)
        before = found[-1].select(G, START, F.col("logdet").alias("before"))
        found.append(now)
        change = now.join(before, [G, START]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        if change is None or change < STILL:
            break
    every = found[0].withColumn("k", F.lit(0))
    for k, df in enumerate(found[1:], 1):
        every = every.union(df.withColumn("k", F.lit(k)))
    names = [START, *MEANS, *FACTOR, "logdet"]
    best = every.groupBy(G).agg(F.min_by(F.struct(*names), F.struct(F.round("logdet", 6), "k", START)).alias("best"))
    return written(best.select(G, *[f"best.{c}" for c in names]).repartition(1), "quality-best")


def judged(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), lang_col: str = "lang", source_col: str = "source", steps: int = STEPS, cut: float = CUT) -> DataFrame:
    """Statistics, ``base_failed``, the distance ``d2`` and ``kept`` of each row."""
    group = F.to_json(F.struct(F.col(lang_col).alias("a"), F.col(source_col).alias("b"))).alias(G)
    named = docs.select(*keep, group, F.col(text_col).alias("__text"))
    rows = written(vectors(statistics(named, "__text", [*keep, G])), "quality")
    factor = least_determinant(rows.filter(~F.col("base_failed")).select(G, *X), steps)
    out = _whitened(rows, factor, "left").drop(START, *[f"y{i}" for i in range(D)])
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= cut)).drop(G, *X)
