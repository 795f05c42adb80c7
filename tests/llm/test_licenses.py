from __future__ import annotations

import pkgutil
import re
import textwrap

from phaseflow.llm import licenses


def test_forms(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [
        (1, mit, 0),
        (2, "// Copyright (c) 2020 Somebody\r\n" + mit.replace("\n", "\r\n * ").upper(), 0),
        (3, mit + " more", 0),
        (4, "Some text.\nLICENSED under the Apache Licence; version 2.0\nmore\n# Released under the MIT License.", 0),
        (5, "Licensed under CC BY-NC 4.0.", 0),
        (6, "We are not Licensed under CC BY-NC 4.0.", 0),
        (7, None, 0),
        (8, "", 0),
        (9, "(c) me\n© you", 0),
        (4, "Some text.\nLICENSED under the Apache Licence; version 2.0\nmore\n# Released under the MIT License.", 0),
        (10, "This work is licensed under the GNU General Public License, version 3.\n" * 3, 0),
        (None, "Released under the MIT License.", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = {r.doc_id: (r.text_license, r.n_notices, r.notices) for r in licenses.scanned(df).collect()}
    assert got == {
        1: ("MIT", 0, ""),
        2: ("MIT", 0, ""),
        3: (None, 0, ""),
        4: (None, 2, "Apache-2.0,MIT"),
        5: ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"),
        6: (None, 0, ""),
        7: (None, 0, ""),
        8: (None, 0, ""),
        9: (None, 0, ""),
        10: (None, 3, "GPL-3.0"),
        None: ("MIT", 1, "MIT"),
    }


def test_equal_spellings_side_by_side(spark):
    df = spark.createDataFrame([("licence licence; sub-licence non-commercial licence, licence",)], "t string")
    form = licenses.F.array_join(licenses.canonical_lines(licenses.F.col("t")), " ")
    assert df.select(form.alias("f")).first().f == "license license sublicense noncommercial license license"


def test_items_of_lists_are_no_statements(spark):
    df = spark.createDataFrame([("(c) You must cause any modified files\n(c) 2020 Somebody\n(C) each of the following\n© 2019 me",)], "t string")
    assert df.select(licenses.canonical_lines(licenses.F.col("t")).alias("x")).first().x == ["c you must cause any modified files", "c each of the following"]


def test_odd_rows(docs, texts, no_docs):
    got = licenses.scanned(docs).collect()
    assert len(got) == len({r[0] for r in texts}) and all(r.n_notices == 0 for r in got)
    assert licenses.scanned(no_docs).count() == 0


def test_no_two_licences_share_a_form(spark):
    texts = licenses.known()
    df = spark.createDataFrame(texts, "license string, text string")
    form = licenses.F.array_join(licenses.canonical_lines(licenses.F.col("text")), " ")
    assert df.select("license", form.alias("f")).groupBy("f").agg(licenses.F.count_distinct("license").alias("n")).filter("n > 1").count() == 0


def wrappings(text: str):
    """The text as it is, on one line, and with its paragraphs in lines of several widths."""
    yield text
    yield " ".join(text.split())
    for width in (0, 25, 40, 60, 70, 72, 76, 78, 80, 100, 120):
        yield "\n\n".join("\n".join(textwrap.wrap(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False)) if width else " ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip("\n")))


def test_wrappings(spark):
    rows = [(f"{k} {n}", w) for k, t in licenses.TEXTS.items() for n, w in enumerate(wrappings(t))]
    out = licenses.scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in out if r.text_license != r.doc_id.split()[0]] == [] and len(out) == len(rows)


def test_statements(spark):
    drop = ["Copyright 2020 A", "Copyright (c) 2020, A", "(c) 2020 A", "© A", " * Copyright: A B", "Copyright The Regents", "Copyright [yyyy] [name]", "(C) Copyright 2020 A", "Copyright (C) <year> A", "copyright by A", "Copyright © A"]
    keep = ["COPYRIGHT HOLDERS BE LIABLE", "copyright notice and this", "copyright owner or", "(c) You must retain", "copyright", "copyright, patent", "copyright law.", "copyright the software"]
    for lines, n in ((drop, 0), (keep, len(keep))):
        df = spark.createDataFrame([("\n".join(lines),)], "text string")
        assert len(df.select(licenses.canonical_lines(licenses.F.col("text"))).first()[0]) == n


def test_whole_texts(spark):
    get = lambda k: pkgutil.get_data("phaseflow.llm", f"license_texts/{k}.txt").decode()
    texts = [(k, get(k)) for k in licenses.FILES]
    bsd = get("BSD-2-Clause").replace("<year> <owner>", "2020, Somebody")
    third = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    texts += [("BSD-3-Clause", bsd.replace("THIS SOFTWARE IS", third + "THIS SOFTWARE IS", 1)), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + bsd)]
    apache = get("Apache-2.0")
    header = apache[apache.index("   Licensed under the Apache License") :]
    texts += [("Apache-2.0", "Copyright 2020 Somebody\n\n" + header), ("Apache-2.0", apache[: apache.index("   APPENDIX")])]
    rows = []
    for i, (k, t) in enumerate(texts):
        own = "Somebody" in t or t.startswith("Copyright")  # a line of its own; neither on one line with others nor cut
        rows += [(f"{k} {i}.{n}", w) for n, w in enumerate(wrappings(t)) if not own or n not in (1, 3)]
    assert {k for k, _ in texts} | set(licenses.TEXTS) >= set(licenses.NAMES)
    out = licenses.scanned(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in out if r.text_license != r.doc_id.split()[0]) == [] and len(out) == len(rows)


def test_no_two_whole_texts_share_a_form(spark):
    df = spark.createDataFrame([*licenses.known(), *licenses.whole_texts()], "license string, text string")
    form = licenses.F.array_join(licenses.canonical_lines(licenses.F.col("text")), " ")
    assert df.groupBy(form.alias("f")).agg(licenses.F.count_distinct("license").alias("n")).filter("n > 1").count() == 0
