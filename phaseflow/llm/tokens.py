"""Tokenization in Python workers and fixed-width token files.

:class:`Encoder` gives the ids of the tokenizers library. For byte-level BPE files with the usual word pattern it
encodes each distinct word once: a blank that stands between two other characters, of which at most the one before is
white space, always begins a new word of that pattern, so a text may be cut there without changing its ids, and words
met before come from a bounded cache. Texts that hold a special token's string or three white space characters in a
row around a blank go through the library whole, as do all texts for tokenizer files of another make.

Token files hold ids in the fewest bits that the vocabulary needs, in blocks of whole documents in ascending id order.
A block is a row of a Parquet table: its documents and their token counts, and the packed ids. The index has the
number of ids before each block, so any span of the stream is found by block and unpacked with numpy alone.

Cases: a null text is empty and has the end id alone; rows with one id follow each other; ids that are null come
first; an empty table gives empty files; long texts are cut at safe blanks, so memory holds some megabytes of words at
a time; extra columns stay out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseflow.llm import worker
from phaseflow.llm.scratch import written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 0
#: A block ends with the document that reaches so many ids.
BLOCK = 1 << 17
#: Words in each of the two generations of a worker's cache, and characters that are split into words at a time.
CACHE, PART = 700_000, 1 << 20

_UNSAFE = re.compile(r"\s \s")
_BLANK = re.compile(r"\s")
#: Words of letters with ASCII punctuation after them, maybe several with single line breaks between: each run of
#: letters or punctuation and each of these breaks is a word of the pattern.
_SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[!-/:-@\[-`{-~]*(?:\n[A-Za-zÀ-ÖØ-öø-ɏ]+[!-/:-@\[-`{-~]*)*")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_RUNS = re.compile(r"\n|[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-/:-@\[-`{-~]+")
_SAFE = re.compile(r"(?<=\S) (?=\S)")

def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


_BYTES = _byte_characters()
_LETTERS = {k: "".join(_BYTES[b] for b in chr(k).encode()) for k in range(0xC0, 0x250)}
_encoders: dict[str, Encoder] = {}

worker.keeps("tokens", _encoders.clear)


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer") and made["model"].get("type") == "BPE" and not made["model"].get("dropout")
        self.special = [x["content"] for x in made.get("added_tokens") or []]
        self.cache: dict[str, bytes] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.old: dict[str, bytes] = {}
        self.bare = {"\n": np.array(line[:1], "<u4").tobytes()}
        # a text that ends in a blank is cut before it, which is right where no token ends in a blank but a blank
        ends = any(len(t) > 1 and t.endswith(_BYTES[32]) for t in self.tokenizer.get_vocab())
        self.by_word = self.by_word and self.line is not None and not ends

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's encoder of a file."""
        worker.enter("tokens")
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: Iterable[str], blank: bool) -> Iterator[bytes]:
        """Ids of runs, each a word of the pattern, after a blank or not, straight from the library's model."""
        before, tokenize = _BYTES[32] if blank else "", self.tokenizer.model.tokenize
        for w in words:
            yield array("I", [t.id for t in tokenize(before + (w if w.isascii() else w.translate(_LETTERS)))]).tobytes()

    def _learn(self, words: set[str]) -> list[str]:
        """Puts words, each after a blank, into the cache; those of several runs are put together from these.

        Returns those with line breaks, which seldom come again.
        """
        cache, bare, old = self.cache, self.bare, self.old
        if old:
            kept = {w: old[w] for w in words if w in old}
            cache.update(kept)
            words = words.difference(kept)
        whole = {w for w in words if w.isalpha() and (w.isascii() or _LATIN.fullmatch(w))}
        runs, plain = {}, []
        for w in words.difference(whole):
            if _SIMPLE.fullmatch(w):
                runs[w] = r = _RUNS.findall(w)
                whole.add(r[0])
            else:
                plain.append(w)
        cache.update(zip(plain, self._plain([f" {w}" for w in plain]), strict=True))
        heads = list(whole.difference(cache))
        cache.update(zip(heads, self._each(heads, True), strict=True))
        if len(bare) > CACHE:
            bare.clear()
            bare["\n"] = np.array([self.line], "<u4").tobytes()
        rest = list({x for r in runs.values() for x in r[1:]}.difference(bare))
        bare.update(zip(rest, self._each(rest, False), strict=True))
        for w, (head, *tail) in runs.items():
            cache[w] = cache[head] + (bare[tail[0]] if len(tail) == 1 else b"".join([bare[x] for x in tail]))
        return [w for w, r in runs.items() if len(r) > 2 and "\n" in r]

    def _words(self, parts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        get = self.cache.get
        split = [p.split(" ") for p in parts]
        found = [[b"", *map(get, islice(s, 1, None))] for s in split]  # the first word has no blank before it
        holes: list[list[int]] = []
        new = set()
        for s, ids in zip(split, found, strict=True):
            at, own = 0, []
            try:
                while True:
                    at = ids.index(None, at + 1)
                    own.append(at)
                    new.add(s[at])
            except ValueError:
                holes.append(own)
        lines = self._learn(new)
        cache = self.cache
        for head, s, ids, own in zip(self._plain([s[0] for s in split]), split, found, holes, strict=True):
            ids[0] = head
            for at in own:
                ids[at] = cache[s[at]]
        for w in lines:
            del cache[w]
        return list(map(b"".join, found))

    def _cut(self, text: str) -> list[str]:
        parts, begin = [], 0
        while len(text) - begin > PART and (m := _SAFE.search(text, begin + PART)):
            parts.append(text[begin : m.start()])
            begin = m.start()
        return [*parts, text[begin:]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        parts: list[str] = []
        ends: list[int] = []

        def flush() -> Iterator[bytes]:
            ids, at = self._words(parts), 0
            for end in ends:
                yield b"".join(ids[at:end])
                at = end

        held = 0
        for text in texts:
            if not self.by_word or any(s in text for s in self.special) or _UNSAFE.search(text):
                if ends:
                    yield from flush()
                    parts, ends, held = [], [], 0
                yield self._plain([text])[0]
                continue
            if len(text) > PART:
                yield from flush()
                parts, ends, held = [], [], 0
                yield b"".join(x for p in self._cut(text) for x in self._words([p]))
                continue
            parts.append(text)
            ends.append(len(parts))
            held += len(text)
            if held > PART:
                yield from flush()
                parts, ends, held = [], [], 0
        if ends:
            yield from flush()


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = END_ID) -> Iterator[tuple[object, bytes]]:
    """(id, ids of the text with the end id) of each row (id, text)."""
    encoder = Encoder.of(path)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for batch in batches:
        step = 256
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                yield key, ids + end


def width(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as a stream of ``bits`` bits each, least significant bit first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    step = 1 << 16  # a multiple of eight ids ends on a byte
    return b"".join(np.packbits(np.unpackbits(raw[at : at + step], axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes() for at in range(0, len(raw), step))


def unpacked(payload: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` (exclusive) of a packed stream."""
    if end <= begin:
        return np.zeros(0, "<u4")
    first = begin * bits // 8
    raw = np.frombuffer(payload, np.uint8, (end * bits + 7) // 8 - first, first)
    out = np.zeros((end - begin, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw.reshape(-1, bits // 8)
        return out.view("<u4").ravel()
    step = 1 << 16
    skip = begin * bits % 8
    for at in range(0, end - begin, step):
        n = min(step, end - begin - at)
        low = at * bits + skip
        piece = np.unpackbits(raw[low // 8 : (low + n * bits + 7) // 8], bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
        out[at : at + n] = np.packbits(np.pad(piece, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return out.view("<u4").ravel()


BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary())])
BLOCKS_DDL = "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, bits int, payload binary"


def _blocks(path: str, end_id: int | None, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part, seq = width(Encoder.of(path).size), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            payload = packed(np.frombuffer(b"".join(held), "<u4"), bits)
            row = {"part": part, "block": seq, "doc_ids": ids, "lengths": [len(x) // 4 for x in held], "n_ids": n, "bits": bits, "payload": payload}
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for key, x in encoded(batches, path, end_id):
            ids.append(key)
            held.append(x)
            n += len(x) // 4
            if n >= block:
                yield flush()
                ids, held, n, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Writes token files and returns them as read back: (blocks, index).

    ``index`` has (part, block, start): the ids before each block. ``path`` names the tokenizer's file on each worker.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id")
    blocks = written(dealt.mapInArrow(_blocks(path, end_id, block), BLOCKS_DDL), "tokens", compression="none")  # packed already
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(before, "part")
    return blocks, written(index.select("part", "block", (F.col("before") + F.col("inside")).alias("start")), "tokens-index")


DOCS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, block, doc_ids, lengths, n, bits, payload = batch.columns
        for row in range(batch.num_rows):
            ids, size = doc_ids[row].values, lengths[row].values.to_numpy()
            ends = np.cumsum(size)
            raw = memoryview(unpacked(memoryview(payload[row].as_buffer()), bits[row].as_py(), 0, n[row].as_py())).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            m = len(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part[row].as_py(), np.int32)), pa.array(np.full(m, block[row].as_py(), np.int32)), ids, pa.array(ends - size), pa.array(size), pa.array(crcs, pa.int64())], schema=DOCS)


def read_documents(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    rows = written(blocks.mapInArrow(_documents, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"), "tokens-read", 4)
    return rows.join(index, ["part", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_span(blocks: DataFrame, index: DataFrame, start: int, length: int) -> np.ndarray:
    """Random access: ids ``start`` to ``start + length`` of the whole stream, from the blocks that hold them only."""
    end = start + length
    hit = blocks.join(index, ["part", "block"]).filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start))
    out = []
    for row in hit.select("start", "n_ids", "bits", "payload").sort("start").toLocalIterator():
        out.append(unpacked(bytes(row.payload), row.bits, max(0, start - row.start), min(row.n_ids, end - row.start)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")
