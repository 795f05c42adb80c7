from __future__ import annotations

import itertools
import json
import random
import zlib
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pytest

from phaseflow.llm import packing, registry, tokens

PATH = registry.tokenizer_file()


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(text: str | None) -> np.ndarray:
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_is_exact(monkeypatch):
    rng = random.Random(0)
    odd = ["a  b", "x\n \nb", " a", "a ", "  ", "", "a\t b", "a \tb", "it's  <|endoftext|> x", "\x1c a \x85 b", "don't.\nStop!?\nNow", "é ü ß 中文 字 😀 x×y÷z", "a.\n\nb", "a.\n b", "x1y2 3.4\n5"]
    odd += ["".join(rng.choice("ab '\n\t  \x1c1.é!") for _ in range(40)) for _ in range(2000)]
    odd.append("".join(rng.choice(["abc", "de", "  ", "\n", " ", "."]) + " x" for _ in range(30_000)))
    for cache, part in ((tokens.CACHE, tokens.PART), (20, 500)):
        monkeypatch.setattr(tokens, "CACHE", cache)
        monkeypatch.setattr(tokens, "PART", part)
        e = tokens.Encoder(PATH)
        assert e.by_word
        assert list(e.encode(odd)) == e._plain(odd)


def test_no_words_where_a_token_holds_two_blanks(tmp_path):
    made = json.loads(Path(PATH).read_text())
    blank = "\u0120"
    made["model"]["vocab"][blank * 2] = max(made["model"]["vocab"].values()) + 1
    first = made["model"]["merges"][0]
    made["model"]["merges"].append(f"{blank} {blank}" if isinstance(first, str) else [blank, blank])
    path = tmp_path / "two.json"
    path.write_text(json.dumps(made))
    e, some = tokens.Encoder(str(path)), ["a  ", "a \n  ", "  a  b", "ab cd"]
    assert not e.by_word and list(e.encode(some)) == e._plain(some)
    assert e._plain(["a  "]) != tokens.Encoder(PATH)._plain(["a  "])


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << bits, 140_001).astype("<u4")
    raw = tokens.packed(x, bits)
    assert len(raw) == -(-len(x) * bits // 8)
    for a, b in ((0, len(x)), (3, 3), (7, 70_000), (65_536, 140_001)):
        assert (tokens.unpacked(raw, bits, a, b) == x[a:b]).all()


def test_token_files(docs, texts):
    blocks, index = tokens.write_tokens(docs, PATH, block=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(blocks, index).collect())
    stream = [(r[0], ids(r[1])) for r in sorted(texts, key=lambda r: r[0])]
    at, want = 0, []
    for i, x in stream:
        want.append((at, i, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    whole = np.concatenate([x for _, x in stream])
    for a, n in ((0, 10), (450, 1200), (at - 5, 5), (at - 5, 50)):
        assert (tokens.read_span(blocks, index, a, n) == whole[a : a + n]).all()
    assert blocks.first().bits == 16


def test_packing(docs, texts):
    out = packing.pack(docs, PATH, capacity=300).toPandas()
    seen = Counter()
    for i, rows in out.groupby("doc_id"):
        x = ids(next(r[1] for r in texts if r[0] == i))
        copies = sum(r[0] == i for r in texts)
        for piece, same in rows.groupby("piece"):
            assert len(same) == copies
            start, length = int(same.start.iloc[0]), int(same.length.iloc[0])
            assert (same.ids_crc32 == zlib.crc32(x[start : start + length].tobytes())).all()
            assert piece == 0 or length == 300
            seen[i] += length
        assert seen[i] == len(x)
    assert set(seen) == {r[0] for r in texts}
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset.to_numpy() == np.cumsum(rows.length) - rows.length).all()
        assert rows.length.sum() <= 300
    assert out.sequence_id.nunique() <= packing.Completion(Counter(out.length.tolist()), 300).bound() + 1


def best(lengths: list[int], capacity: int) -> int:
    """Fewest bins, by trying all."""
    lengths = sorted(lengths, reverse=True)
    found = len(lengths)

    def place(k, bins):
        nonlocal found
        if len(bins) >= found:
            return
        if k == len(lengths):
            found = len(bins)
            return
        for left in {*bins}:
            if left >= lengths[k]:
                rest = list(bins)
                rest.remove(left)
                place(k + 1, [*rest, left - lengths[k]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return found


def test_completion_against_all_packings():
    rng = random.Random(1)
    for k in range(300):
        capacity = rng.choice([20, 50])
        low, high = ((1, capacity), (capacity // 6, capacity * 2 // 3))[k % 2]
        lengths = [rng.randint(low, high) for _ in range(rng.choice([6, 8, 9, 10]))]
        completion = packing.Completion(Counter(lengths), capacity)
        plan = completion.solve()
        assert plan.proven and plan.bins == best(lengths, capacity) >= completion.bound(), (lengths, capacity)


def test_one_bin_fewer_than_best_fits():
    completion = packing.Completion(Counter([3, 5, 5, 6, 7, 9, 10, 11, 11, 12]), 20)
    assert sum(times for _, times in completion._greedy()) == 5
    assert completion.solve().bins == 4


def test_dominated_fillings():
    """Against the definition: all sets of the items in a filling, all items outside it."""
    rng = random.Random(2)
    for _ in range(400):
        items = Counter(rng.randint(1, 12) for _ in range(8))
        table = packing.Lengths(np.array([items[x] for x in range(21)]), 20)
        gap = 20 - table.present[-1]
        rest = items - Counter([table.present[-1]])
        for filling in table.fillings(gap, 10_000, [gap]):
            other, room = rest - Counter(filling), gap - sum(filling)
            sets = [s for n in range(len(filling) + 1) for s in itertools.combinations(filling, n)]
            swap = lambda s, e: sum(s) <= e <= sum(s) + room and (len(s) != 1 or s[0] < e)  # noqa: E731, B023
            assert table.dominated(filling, gap) == any(swap(s, e) for s in sets for e in other), (items, filling)


def test_limits_are_told():
    lengths = Counter(np.random.default_rng(0).integers(600, 760, 500).tolist())
    plan = packing.Completion(lengths, steps=1000).solve()
    assert not plan.proven and plan.bins >= packing.Completion(lengths).bound()


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    assert tokens.read_documents(*tokens.write_tokens(no_docs, PATH)).count() == 0
