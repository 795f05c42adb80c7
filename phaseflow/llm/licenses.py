"""License scans by canonical digest lookup.

Texts are brought to a canonical form: ASCII letters in lower case, copyright statements left out, every run of other
characters than letters and digits one blank, equivalent spellings one spelling. The digest of an entire text, and of
each of its lines (a line may be a whole notice), is joined with the digests of known licences in the same form. The
table of known digests is a list that the driver holds, so it is small enough to be broadcast whatever the corpus;
nothing but hits leaves the scan, and no part of a text decides, only a whole text or line.

Cases: a null or empty text has no licence; a text of copyright statements alone is empty; repeated rows of one id are one
document; a text longer than any known licence is compared like others; an empty table gives an empty result; extra
columns stay out. Plain DataFrame operations.
"""

from __future__ import annotations

import pkgutil
import re
import string
import textwrap
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseflow.llm.scratch import written

#: Lines that the SQL leaves out: all that begin with the word. Here only statements are left out (``STATEMENT``), so that
#: it does not matter where the lines of a text end; the SQL differs where a sentence about copyright begins a line.
COPYRIGHT = r"^[^a-z0-9©(]*(?:copyright\b|©|\(c\))"
#: What follows the word, or an item (c), in sentences of licences.
PROSE = (
    "and", "are", "as", "by the", "disclaimer", "doctrines?", "for", "holders?", "if", "in", "including", "interests?", "is", "it", "laws?", "licen[sc]es?", "licensed", "notices?", "of", "on", "or",
    "owners?", "owned", "owner's", "ownership", "permission", "protection", "resulting from", "rights?", "statements?", "status", "that", "the library", "the program", "the software", "to", "treat(?:y|ies)", "under", "works?",
)
ITEM = (*PROSE, "accompany", "any", "each", "every", "no", "prohibiting", "representations?", "such", "the licen[sc]es?", "this", "you", "your")
_SIGN = r"(?:[\s:]*(?:copyright\b|©|\(c\)))*[\s:]*(?:by\s+)?"
#: A copyright statement: the word or a sign, then a year, a place for one, or a holder.
STATEMENT = rf"^[^a-z0-9©(]*(?:©|(?:copyright\b|\(c\)\s*copyright\b){_SIGN}(?!(?:{'|'.join(PROSE)})\b)[\p{{L}}\p{{N}}<\[{{(]|\(c\){_SIGN}(?!(?:{'|'.join(ITEM)})\b)[\p{{L}}\p{{N}}<\[{{])"
OTHER = r"[^\p{L}\p{N}]+"
#: Spellings that count as equal, in canonical form.
EQUAL = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("http", "https"),
)

#: Names of licences as notices write them.
NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT license", "MIT"),
    "ISC": ("the ISC License", "ISC License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "Apache-2.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "Unlicense": ("the Unlicense",),
}
VERBS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This file is licensed under {}.", "This project is licensed under {}.", "Distributed under {}.", "SPDX-License-Identifier: {}")

#: Whole licence texts.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
}


def known() -> list[tuple[str, str]]:
    """(licence, text): the notices that verbs and names make, and the whole texts, with titles and without."""
    names = {k: list(v) for k, v in NAMES.items()}
    for version in (1, 2, 3):
        names[f"GPL-{version}.0"] = [f"the GNU General Public License, version {version}", f"the GNU General Public License v{version}.0", f"the GPLv{version}", f"GPL-{version}.0"]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"a CC {kind} {version} license", f"CC-{kind}-{version}"]
    notices = [(license, verb.format(name)) for license, some in names.items() for name in some for verb in VERBS]
    untitled = [(k, t.partition("\n\n")[2]) for k, t in TEXTS.items() if t.startswith(f"{k} License")]
    titled = [(k, f"The {k} License ({k})\n\n{t}") for k, t in untitled]
    return [*notices, *TEXTS.items(), *untitled, *titled]


#: Licences whose whole texts stand in ``license_texts``.
FILES = (
    "Apache-2.0", "MPL-1.1", "MPL-2.0", "BSD-2-Clause", "Unlicense", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl",
    "CC0-1.0", "CC-BY-SA-4.0",
)
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""
#: Addresses that the licence's owner has had.
ADDRESS = r"51 Franklin Street, Fifth Floor, Boston,? MA\s+02110-1301 USA"
FORMER = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: From where to where the standard headers stand in the texts.
HEADERS = {
    "Apache-2.0": ("   Licensed under the Apache", None),
    "MPL-2.0": ("  This Source Code Form is subject", "If it is not possible"),
    "GPL-1.0": ("    This program is free software", "Also add information"),
    "GPL-2.0": ("    This program is free software", "Also add information"),
    "GPL-3.0": ("    This program is free software", "Also add information"),
    "LGPL-2.0": ("    This library is free software", "Also add information"),
    "LGPL-2.1": ("    This library is free software", "Also add information"),
}
END = "END OF TERMS AND CONDITIONS"


def _from(text: str, begin: str, end: str | None) -> str:
    at = text.index(begin)
    return text[at : None if end is None else text.index(end, at)]


def _wrapped(text: str) -> set[str]:
    """One line for each way that the ends of lines let copyright statements stand at the beginning of one."""
    statement = re.compile(STATEMENT.replace(r"\p{L}\p{N}", r"\w"))
    kept = lambda lines: " ".join(x for x in lines if not statement.search(x.lower()))
    parts = re.split(r"\n[^\S\n]*\n", text)
    of_width: list[list[str]] = [[] for _ in range(103)]
    for part in parts:
        flat = " ".join(part.split())
        some = re.search(r"copyright\s*(?:\(c\)|<|\[|\d)|\(c\)\s*(?:copyright|\d|<)", flat.lower())
        for k, forms in enumerate(of_width):
            if not some or k == 0:
                forms.append(flat)
            elif k == 1:
                forms.append(kept(part.split("\n")))
            else:
                forms.append(kept(textwrap.wrap(flat, 18 + k, break_on_hyphens=False, break_long_words=False) if k > 2 else [flat]))
    return {" ".join(forms) for forms in of_width}


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text): the texts in ``license_texts`` and what is made of them, each without its appendix too, and the
    standard headers."""
    texts = {k: pkgutil.get_data(__package__, f"license_texts/{k}.txt").decode() for k in FILES}
    some = [(k, t) for k, t in texts.items() if not k.startswith("BSD")]
    bsd = texts["BSD-2-Clause"].partition("\n")[2].strip()
    for name, text in (("BSD-2-Clause", bsd), ("BSD-3-Clause", bsd.replace("THIS SOFTWARE IS", f"{THIRD}THIS SOFTWARE IS", 1))):
        for form in (text, text.replace("HOLDER OR", "OWNER OR"), re.sub(r"(?m)^\d\. ", "* ", text)):
            some += [(name, f"{title}\n\n{form}") for title in ("", name.replace("-Clause", "-Clause License").replace("BSD-", "BSD "))]
    some += [(k, t.partition(END)[0] + end) for k, t in texts.items() if END in t for end in ("", END)]
    some += [(k, _from(texts[k], *ends)) for k, ends in HEADERS.items()]
    by = texts["CC-BY-SA-4.0"]
    body = by[by.index("Creative Commons Attribution-ShareAlike 4.0") :]
    some += [("CC-BY-SA-4.0", body), ("CC-BY-SA-4.0", body[: body.rindex("Creative Commons is not a party")])]
    some += [(k, re.sub(ADDRESS, a, t)) for k, t in some if re.search(ADDRESS, t) for a in FORMER]
    return sorted({(k, form) for k, t in some for form in _wrapped(t)})


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that is no copyright statement and not empty."""
    low = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n"), string.ascii_uppercase, string.ascii_lowercase)

    def form(line: Column) -> Column:
        line = F.concat(F.lit(" "), F.trim(F.regexp_replace(line, OTHER, "  ")), F.lit(" "))  # each word has blanks of its own
        for a, b in EQUAL:
            line = F.replace(line, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
        return F.trim(F.replace(line, F.lit("  "), F.lit(" ")))

    lines = F.filter(F.split(low, "\n"), lambda x: ~x.rlike(STATEMENT))
    return F.filter(F.transform(lines, form), lambda x: x != "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(docs: DataFrame, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(digest, n_chars, license); of licences with one canonical form the least name counts."""
    df = docs.sparkSession.createDataFrame(list(texts), "license string, text string")
    form = F.array_join(canonical_lines(F.col("text")), " ")
    return df.select(digest(form).alias("digest"), F.length(form).alias("n_chars"), "license").groupBy("digest", "n_chars").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """A row an id: ``text_license`` (null if the entire text is none), ``n_notices`` lines and their ``notices``."""
    rows = [(r["digest"], r["n_chars"], r["license"]) for r in known_digests(docs, texts or [*known(), *whole_texts()]).collect()]  # of the driver's own list
    table = docs.sparkSession.createDataFrame(rows, "digest string, n_chars int, license string")
    sizes = sorted({n for _, n, _ in rows})
    lines = docs.select(F.col(id_col).alias("__id"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = F.struct(F.lit(-1).alias("at"), F.array_join("lines", " ").alias("form"))
    units = F.concat(F.array(whole), F.transform("lines", lambda x, k: F.struct(k.alias("at"), x.alias("form"))))
    units = F.filter(units, lambda u: F.length(u["form"]).isin(sizes))  # other lengths have other digests
    found = lines.select("__id", F.explode(units).alias("u")).select("__id", "u.at", digest(F.col("u.form")).alias("digest"))
    hits = written(found.join(F.broadcast(table), "digest").select("__id", "at", "license"), "license-hits")
    notice = F.when(F.col("at") >= 0, F.col("license"))
    of = hits.groupBy("__id").agg(
        F.min(F.when(F.col("at") < 0, F.col("license"))).alias("text_license"),
        F.count_distinct(F.when(F.col("at") >= 0, F.col("at"))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notices"),
    )
    ids = docs.select(F.col(id_col).alias("__id")).distinct()
    out = ids.join(of, ids["__id"].eqNullSafe(of["__id"]), "left").select(ids["__id"].alias(id_col), "text_license", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
    return out
