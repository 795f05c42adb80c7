"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` ids; only longer documents are cut, and the first piece takes the
remainder. Packing depends on lengths alone and there are at most ``capacity`` different ones, so the driver solves
the histogram of lengths, however many pieces there are.

Bin completion: around the largest length left, the fillings of the rest of its bin are enumerated, larger items first. A
filling is dominated, and left out, if some item that is not in it fits beside it, or fits in place of a smaller item or of
several items that together are no larger: whatever packs the rest with the former does so with the latter. The first
solution takes the best fit throughout and is the incumbent. If it needs more bins than the lower bound, branch and bound
goes through the undominated fillings of each bin, best fit first; a branch ends where its waste so far, or the bins that
its rest needs at least, leave no room for one bin fewer than the incumbent. A filling is used as often as the counts
allow, and in a branch of its own once. The search ends when nothing is left (the packing is proven to be best) or after
``STEPS`` steps; ``Plan.proven`` says whether the packing is known to be best. The one fit of the incumbent is sought for
at most ``FIT_STEPS`` steps. Pieces take their places by their rank among the pieces of their length; ranks come from
square-root decomposition, so a length that a third of all pieces share is dealt to many tasks.

Cases: a null or empty text is the end id alone; repeated rows are packed like others; an empty table gives an empty
result; texts of any length are tokenized whole; extra columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseflow.llm import tokens
from phaseflow.llm.scratch import written
from phaseflow.llm.text import id_hash

CAPACITY = 2048
#: Items tried in fillings by the whole search beyond the incumbent, by the search for one best fit, and what a branch
#: counts as.
STEPS, FIT_STEPS, BRANCH = 1_000_000, 5_000, 250


@dataclass(frozen=True)
class Plan:
    """Runs of slots by (length, first rank): runs are sorted, ``key`` is length * 2**40 + first rank."""

    key: np.ndarray
    sequence: np.ndarray  # of the run's first slot
    each: np.ndarray  # slots of the length in one bin of the run
    offset: np.ndarray  # of the first of these
    bins: int
    proven: bool  # no packing takes fewer bins

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank from 0."""
        at = np.searchsorted(self.key, (length << 40) + rank, "right") - 1
        slot = rank - (self.key[at] & ((1 << 40) - 1))
        return self.sequence[at] + slot // self.each[at], self.offset[at] + slot % self.each[at] * length


#: A filling of one bin, largest length first, and how many bins get it.
Step = tuple[tuple[int, ...], int]


class Completion:
    """Bin completion over counts of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS):
        self.capacity, self.left = capacity, steps
        self.all = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.all[length] = n

    def bound(self, counts: np.ndarray | None = None) -> int:
        """Bins that any packing needs: for each k, lengths above half the capacity take a bin each, those that leave
        less than k take it alone, and lengths from k to half share what is left and further bins."""
        counts, size = self.all if counts is None else counts, self.capacity
        n, total = (np.concatenate(([0], np.cumsum(v))) for v in (counts, counts * np.arange(size + 1)))
        k, half = np.arange(size // 2 + 1), size // 2 + 1
        alone = n[-1] - n[size - k + 1]
        wide, wide_sum = n[size - k + 1] - n[half], total[size - k + 1] - total[half]
        rest = (total[half] - total[k]) - (wide * size - wide_sum)
        return int((alone + wide + np.maximum(0, -(-rest // size))).max())

    def solve(self) -> Plan:
        best, least = self._greedy(), self.bound()
        proven = sum(t for _, t in best) == least
        if not proven:
            best, proven = self._search(best, least)
        return self._plan(best, proven)

    def _greedy(self) -> list[Step]:
        """Best fits throughout."""
        counts, out = self.all.copy(), []
        table = Lengths(counts, self.capacity)
        while table.present:
            filling = (table.present[-1], *table.best_fit(self.capacity - table.present[-1], FIT_STEPS))
            out.append((filling, table.times(filling)))
            table = table.without(*out[-1])
        return out

    def _search(self, best: list[Step], least: int) -> tuple[list[Step], bool]:
        """Branch and bound: the best solution found, and whether none is better."""
        fewest, total = sum(t for _, t in best), int((self.all * np.arange(self.capacity + 1)).sum())
        path: list[Step] = []
        whole = Lengths(self.all, self.capacity)
        stack = [(whole, 0, 0, self._branches(whole, (fewest - 1) * self.capacity - total))]
        while stack and self.left > 0:
            table, bins, waste, branches = stack[-1]
            step = next(branches, None)
            if step is None:
                stack.pop()
                path = path[:-1]
                continue
            filling, times = step
            wasted, used = waste + times * (self.capacity - sum(filling)), bins + times
            spare = (fewest - 1) * self.capacity - total - wasted
            if spare < 0:
                continue
            rest = table.without(filling, times)
            self.left -= BRANCH
            if not rest.present:
                best, fewest = [*path, step], used
                if fewest == least:
                    return best, True
            elif used + self.bound(rest.counts) < fewest:
                path = [*path, step]
                stack.append((rest, used, wasted, self._branches(rest, spare)))
        return best, self.left > 0

    def _branches(self, table: Lengths, spare: int) -> Iterator[Step]:
        """Undominated fillings of the bin of the largest length that waste at most ``spare``, best fit first: as often as
        they go, and once."""
        largest, gap = table.present[-1], self.capacity - table.present[-1]
        least = table.waste[gap]
        for some in (self._undominated(table, gap, 0, min(least, spare)), sorted(self._undominated(table, gap, least + 1, spare), key=sum, reverse=True) if spare > least else ()):
            for f in some:
                filling = (largest, *f)
                times = table.times(filling)
                yield filling, times
                if times > 1:
                    yield filling, 1

    def _undominated(self, table: Lengths, gap: int, least: int, most: int) -> Iterator[tuple[int, ...]]:
        before = table.steps
        for f in table.fillings(gap, before + self.left, [most]):
            self.left, before = self.left - (table.steps - before), table.steps
            if gap - sum(f) >= least and not table.dominated(f, gap):
                yield f
                before = table.steps
        self.left -= table.steps - before

    def _plan(self, steps: list[Step], proven: bool) -> Plan:
        used: dict[int, int] = {}
        runs: list[tuple[int, int, int, int]] = []
        bins = 0
        for filling, times in steps:
            offset = 0
            for x in sorted(set(filling), reverse=True):
                k = filling.count(x)
                runs.append(((x << 40) + used.get(x, 0), bins, k, offset))
                used[x] = used.get(x, 0) + k * times
                offset += k * x
            bins += times
        runs.sort()
        key, sequence, each, off = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 4
        return Plan(key, sequence, each, off, bins, proven)


class Lengths:
    """Counts of the lengths that are left, and what sums they can make."""

    def __init__(self, counts: np.ndarray, capacity: int, like: Lengths | None = None):
        self.counts, self.capacity, self.steps = counts, capacity, 0
        if like is not None:
            self.present, self.below, self.waste, self.bits = like.present, like.below, like.waste, like.bits
            return
        self.present = np.flatnonzero(counts).tolist()
        self.bits = sum(1 << x for x in self.present)
        sums, full = 1, (1 << (capacity + 1)) - 1
        for x in self.present:
            width = x
            while width <= capacity:
                sums |= sums << width & full
                width *= 2
        at = np.arange(capacity + 1)
        reach = np.array([c == "1" for c in reversed(f"{sums:0{capacity + 1}b}")])
        #: Least waste that a gap can be left with (a bound: counts are left out), and the largest length up to a place.
        self.waste = (at - np.maximum.accumulate(np.where(reach, at, 0))).tolist()
        self.below = np.maximum.accumulate(np.where(counts > 0, at, 0)).tolist()

    def times(self, filling: tuple[int, ...]) -> int:
        return min(int(self.counts[x]) // filling.count(x) for x in set(filling))

    def without(self, filling: tuple[int, ...], times: int) -> Lengths:
        counts = self.counts.copy()
        for x in filling:
            counts[x] -= times
        return Lengths(counts, self.capacity, self if all(counts[x] for x in filling) else None)

    def best_fit(self, gap: int, steps: int) -> tuple[int, ...]:
        """The filling of ``gap`` that wastes least, of those that ``steps`` steps come to."""
        best: tuple[int, ...] = ()
        most = [gap - 1]
        if most[0] >= self.waste[gap]:
            for best in self.fillings(gap, self.steps + steps, most):
                most[0] = gap - sum(best) - 1
                if most[0] < self.waste[gap]:
                    break
        return best

    def fillings(self, gap: int, steps: int, most: list[int]) -> Iterator[tuple[int, ...]]:
        """Fillings of ``gap`` beside one of the largest length that waste ``most[0]`` at most, which may fall meanwhile;
        items falling, larger ones first, until ``self.steps`` reaches ``steps``."""
        counts, largest = self.counts, self.present[-1]
        chosen: list[int] = []
        nexts = [min(gap, largest)]  # largest length to try beside those chosen, for each depth
        left = gap
        if left <= most[0]:
            yield ()
        while nexts and self.steps < steps:
            self.steps += 1
            x = self.below[nexts[-1]]
            if x == 0:
                nexts.pop()
                if chosen:
                    left += chosen.pop()
                continue
            nexts[-1] = x - 1
            if self.waste[left - x] > most[0] or counts[x] - (x == largest) <= chosen.count(x):
                continue
            chosen.append(x)
            left -= x
            nexts.append(min(left, x))
            if left <= most[0]:
                yield tuple(chosen)

    def dominated(self, filling: tuple[int, ...], gap: int) -> bool:
        """Whether an item that is not in the filling fits beside it, or in place of a smaller item or of several that
        together are no larger."""
        residual, other = gap - sum(filling), self.bits
        single, several, sums = 0, 0, 1
        for x in filling:
            several |= (sums & ~1) << x
            single |= 1 << x
            sums |= sums << x
        for x in {*filling, self.present[-1]}:
            if self.counts[x] - (x == self.present[-1]) <= filling.count(x):
                other &= ~(1 << x)
        if other & ((2 << residual) - 1):
            return True
        width = 1  # sums widened to what an item may be larger by
        while width <= residual:
            more = min(width, residual + 1 - width)
            several |= several << more
            width += more
        larger, width = (single << 1) if residual else 0, 1
        while width < residual:
            more = min(width, residual - width)
            larger |= larger << more
            width += more
        return bool(other & (several | larger))


    def dominated(self, filling: tuple[int, ...], gap: int) -> bool:
        """Whether an item that is not in the filling fits beside it, or in place of a smaller item or of several that
        together are no larger."""
        residual = gap - sum(filling)
        single, several, sums = 0, 0, 1
        for x in filling:
            several |= (sums & ~1) << x
            single |= 1 << x
            sums |= sums << x
        for e in self.present:
            if e > gap or self.counts[e] - (e == self.present[-1]) <= filling.count(e):
                continue
            if e <= residual:
                return True
            low = e - residual
            if several >> low & ((1 << (residual + 1)) - 1) or single >> low & ((1 << residual) - 1):
                return True
        return False


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for key, ids in tokens.encoded(batches, path, end_id):
            n, raw = len(ids) // 4, memoryview(ids)
            begin, piece = 0, 0
            while begin < n:
                end = begin + ((n - begin - 1) % capacity + 1)
                rows.append((key, piece, begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])))
                begin, piece = end, piece + 1
            if len(rows) >= 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            keep = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, no sequence above ``capacity``."""
    cut = written(pieces(docs, path, id_col, text_col, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = Completion(counts, capacity).solve()
    parts = cut.sparkSession.createDataFrame([(int(x), int(np.ceil(np.sqrt(n)))) for x, n in counts.items()], "length long, parts int")
    rows = cut.join(F.broadcast(parts), "length")  # one row a length
    rows = rows.withColumn("block", F.pmod(id_hash(F.concat_ws(":", "doc_id", "piece")), F.col("parts"))).drop("parts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    ranked = rows.join(written(blocks, "pieces-blocks"), ["length", "block"]).withColumn("rank", (F.col("before") + inside - 1).cast("long"))
    return ranked.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
