"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The documents of a source
stand in a fixed order; their expected copies are summed up along it, a random offset of the source is added, and a
document is emitted once for each integer that the sum passes at it.

The order is by size class first, so that each stretch of it holds documents of about one size and the words taken
differ from the target by little more than one document. Ranks along the order are found by square-root decomposition:
the n rows of a class are dealt by a hash of their id to about sqrt(n) blocks, blocks are counted and summed up, and
rows are numbered inside their block. No task orders more than a block, however large a source is.

Cases: a null text has size 0; a null source is a source of its own and comes last; rows of size 0 get the copies that
the order gives them and take no words; an empty table gives an empty result; identical rows are rows of their own.
Extra columns stay. Plain DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseflow.llm.scratch import written
from phaseflow.llm.text import id_hash, n_words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"

P = "__mix_"
ROW = P + "row"
G = [P + "null", P + "source"]


def size_class(size: Column) -> Column:
    """Eight classes to the octave, ascending with the size; sizes under 8 are classes of their own."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 16 + F.call_function("shiftright", size, bits - 4)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target of each source from (null flag, source, source size): one row per source goes in and comes out.

    Shares go by weight; a source at ``max_repeat`` times its size is full and the excess goes to the others. With the
    sources in the order of size / weight the full ones are a prefix, found by running sums instead of a loop.
    """
    by_name = Window.orderBy(*G)
    fill = Window.orderBy("rho", *G)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col(P + "total") * max_repeat)
    one = one.withColumn("rho", F.col("cap") / F.col("w").cast("double"))
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_w = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(P + "total").over(Window.partitionBy())
    one = one.withColumn("level", (total - full).cast("double") / open_w.cast("double"))
    level = F.min(F.when(F.col("rho") > F.col("level"), F.struct("rho", *G, "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap").cast("double"), F.col("w").cast("double") * F.coalesce(level, F.lit(0.0)))
    return one.select(*G, P + "total", target.alias(P + "target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` without its text, with ``size``, ``source_size``, ``target`` and ``copies`` of each row, and ``ROW``, a hash
    of all its columns.

    Columns of ``docs`` of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, ROW, "size", "source_size", "target", "copies")]
    size = n_words(F.col(text_col))
    rows = written(docs.select(*keep, row_hash(docs).alias(ROW), size.alias("size")), "mix-sizes")
    keep.append(ROW)
    source = F.col(source_col)
    rows = rows.withColumns({G[0]: source.isNull(), G[1]: F.coalesce(source.cast("string"), F.lit("")), P + "class": size_class(F.col("size"))})
    classes = written(rows.groupBy(*G, P + "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")), "mix-classes")
    of_source = classes.groupBy(*G).agg(F.sum("total").alias(P + "total"))
    parts = classes.select(*G, P + "class", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long").alias(P + "parts"))
    rows = rows.join(parts, [*G, P + "class"]).withColumn(P + "block", F.pmod(id_hash(F.col(id_col)), F.col(P + "parts"))).drop(P + "parts")
    block = [*G, P + "class", P + "block"]
    before = F.sum(P + "n").over(Window.partitionBy(*G).orderBy(P + "class", P + "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*block).agg(F.count(F.lit(1)).alias(P + "n")).withColumn(P + "before", F.coalesce(before, F.lit(0)))
    blocks = written(blocks.join(targets(of_source, weights, max_repeat), G), "mix-blocks").drop(P + "n")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(F.col(id_col), F.col("size")))
    out = rows.join(blocks, block).withColumn(P + "rank", F.col(P + "before") + inside)
    offset = id_hash(F.concat(F.lit(f"{seed}:"), F.col(G[0]).cast("string"), F.lit(":"), F.col(G[1]))) / F.lit(float(2**32))
    rate = F.when(F.col(P + "total") > 0, F.col(P + "target") / F.col(P + "total").cast("double")).otherwise(F.lit(0.0))
    passed = F.floor(F.col(P + "rank") * rate + offset) - F.floor((F.col(P + "rank") - 1) * rate + offset)
    return out.select(*keep, "size", F.col(P + "total").alias("source_size"), F.col(P + "target").alias("target"), passed.cast("long").alias("copies"))


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(*[F.struct(F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNull()) for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])


def emitted(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (id, ``ROW``, copies) takes it; rows that are the same in all columns
    together as often as all of them are taken."""
    takes = mixed.groupBy(F.col(id_col).alias(P + "id"), F.col(ROW).alias(P + "own")).agg(F.sum("copies").alias(P + "copies"), F.count(F.lit(1)).alias(P + "rows"))
    takes = written(takes.filter(F.col(P + "copies") > 0), "mix-takes")
    keyed = docs.select(*docs.columns, row_hash(docs).alias(P + "row_here"))

    def of(takes: DataFrame) -> DataFrame:
        return keyed.join(takes.hint("shuffle_hash"), keyed[id_col].eqNullSafe(takes[P + "id"]) & (keyed[P + "row_here"] == takes[P + "own"]))

    found = of(takes.filter(F.col(P + "rows") == 1)).select(*docs.columns, P + "copies")
    several = takes.filter(F.col(P + "rows") > 1)
    if not several.isEmpty():
        one = of(several).groupBy(P + "id", P + "own", P + "copies").agg(F.first(F.struct(*docs.columns)).alias(P + "row"))
        found = found.union(one.select(P + "row.*", P + "copies"))
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(P + "copies").cast("int"))).alias(P + "copy")).drop(P + "copy")
