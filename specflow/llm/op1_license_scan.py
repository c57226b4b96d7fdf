"""License scan: ordered signature rules gated by keywords, with suppression of
detections that lie inside others.  DataFrame functions only; no shuffle.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: A word character: a letter or digit, or anything beyond ASCII.
_W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_S = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License identifiers (SPDX) and their wordings.
# In a wording a space stands for any run of characters that aren't part of words; ? marks an optional word.
LICENSES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit license", "expat license")),
    ("MIT-0", ("mit no attribution", "mit no attribution license")),
    ("Apache-1.1", ("apache software license version? 1 1", "apache license version? 1 1")),
    ("Apache-2.0", ("apache license version? 2 0?", "apache software license version? 2 0?", "asl 2 0")),
    ("BSD-2-Clause", ("bsd 2 clause license?", "simplified bsd license", "freebsd license", "two clause bsd license?")),
    ("BSD-3-Clause", ("bsd 3 clause license?", "new bsd license", "modified bsd license", "three clause bsd license?")),
    ("BSD-4-Clause", ("bsd 4 clause license?", "original bsd license", "four clause bsd license?")),
    ("0BSD", ("bsd zero clause license?", "zero clause bsd license?")),
    ("GPL-1.0", ("gnu general public license version? 1", "gnu gpl v1")),
    ("GPL-2.0", ("gnu general public license version? 2 0?", "gnu? general public license v2")),
    ("GPL-3.0", ("gnu general public license version? 3 0?", "gnu? general public license v3")),
    ("LGPL-2.0", ("gnu library general public license version? 2 0?",)),
    ("LGPL-2.1", ("gnu lesser general public license version? 2 1", "gnu? lesser general public license v2 1")),
    ("LGPL-3.0", ("gnu lesser general public license version? 3 0?", "gnu? lesser general public license v3")),
    ("AGPL-1.0", ("affero general public license version? 1 0?",)),
    ("AGPL-3.0", ("gnu? affero general public license version? 3 0?", "gnu? affero general public license v3")),
    ("GFDL-1.2", ("gnu free documentation license version? 1 2",)),
    ("GFDL-1.3", ("gnu free documentation license version? 1 3",)),
    ("MPL-1.0", ("mozilla public license version? 1 0",)),
    ("MPL-1.1", ("mozilla public license version? 1 1",)),
    ("MPL-2.0", ("mozilla public license version? 2 0?",)),
    ("EPL-1.0", ("eclipse public license version? 1 0", "eclipse public license v1 0")),
    ("EPL-2.0", ("eclipse public license version? 2 0", "eclipse public license v2 0")),
    ("CDDL-1.0", ("common development and distribution license version? 1 0",)),
    ("CDDL-1.1", ("common development and distribution license version? 1 1",)),
    ("CPL-1.0", ("common public license version? 1 0",)),
    ("EUPL-1.1", ("european union public licen[cs]e version? 1 1",)),
    ("EUPL-1.2", ("european union public licen[cs]e version? 1 2",)),
    ("Artistic-1.0", ("artistic license version? 1 0", "perl artistic license")),
    ("Artistic-2.0", ("artistic license version? 2 0",)),
    ("BSL-1.0", ("boost software license version? 1 0?",)),
    ("BUSL-1.1", ("business source license version? 1 1",)),
    ("SSPL-1.0", ("server side public license version? 1 0?",)),
    ("Elastic-2.0", ("elastic license version? 2 0", "elastic license v2")),
    ("ISC", ("isc license", "internet systems consortium license")),
    ("Zlib", ("zlib license", "zlib libpng license")),
    ("Unlicense", ("the unlicense", "unlicense org")),
    ("WTFPL", ("wtfpl version? 2?", "wtfpl license")),
    ("Python-2.0", ("python license version? 2 0?", "python software foundation license version? 2?")),
    ("PHP-3.01", ("php license version? 3 01",)),
    ("Ruby", ("ruby license",)),
    ("PostgreSQL", ("postgresql licen[cs]e",)),
    ("OpenSSL", ("openssl license",)),
    ("NCSA", ("university of illinois ncsa open source license", "ncsa open source license")),
    ("AFL-3.0", ("academic free license version? 3 0",)),
    ("OSL-3.0", ("open software license version? 3 0",)),
    ("MS-PL", ("microsoft public license",)),
    ("MS-RL", ("microsoft reciprocal license",)),
    ("OFL-1.1", ("sil? open font license version? 1 1",)),
    ("LPPL-1.3c", ("latex project public license version? 1 3c?",)),
    ("UPL-1.0", ("universal permissive license version? 1 0?",)),
    ("W3C", ("w3c software notice and license", "w3c software license")),
    ("MulanPSL-2.0", ("mulan permissive software license version? 2", "mulan psl v2")),
    ("CC0-1.0", ("cc0 1 0 universal?", "cc0 public domain dedication?")),
    ("CC-BY-3.0", ("creative commons attribution 3 0",)),
    ("CC-BY-4.0", ("creative commons attribution 4 0",)),
    ("CC-BY-SA-3.0", ("creative commons attribution sharealike 3 0",)),
    ("CC-BY-SA-4.0", ("creative commons attribution sharealike 4 0",)),
    ("CC-BY-ND-4.0", ("creative commons attribution noderivatives 4 0",)),
    ("CC-BY-NC-4.0", ("creative commons attribution noncommercial 4 0",)),
    ("CC-BY-NC-SA-4.0", ("creative commons attribution noncommercial sharealike 4 0",)),
    ("CC-BY-NC-ND-4.0", ("creative commons attribution noncommercial noderivatives 4 0",)),
    ("ODbL-1.0", ("open database license version? 1 0?",)),
    ("ODC-By-1.0", ("open data commons attribution license version? 1 0?",)),
    ("PDDL-1.0", ("open data commons public domain dedication and? license? 1? 0?",)),
    ("public-domain", ("released into the public domain", "dedicated to the public domain")),
    ("proprietary", ("proprietary and confidential all rights reserved", "all rights reserved do not distribute")),
]
# Creative Commons codes and the licenses that they are short for, as words.
SHORT = {"cc by": "CC-BY", "cc by sa": "CC-BY-SA", "cc by nd": "CC-BY-ND", "cc by nc": "CC-BY-NC",
         "cc by nc sa": "CC-BY-NC-SA", "cc by nc nd": "CC-BY-NC-ND"}
# Addresses of license texts.
ADDRESSES = {"apache.org/licenses/license-2.0": "Apache-2.0", "opensource.org/licenses/mit": "MIT",
             "opensource.org/licenses/bsd-3-clause": "BSD-3-Clause", "opensource.org/licenses/bsd-2-clause": "BSD-2-Clause",
             "gnu.org/licenses/gpl-2.0": "GPL-2.0", "gnu.org/licenses/gpl-3.0": "GPL-3.0", "gnu.org/licenses/lgpl-2.1": "LGPL-2.1",
             "gnu.org/licenses/lgpl-3.0": "LGPL-3.0", "gnu.org/licenses/agpl-3.0": "AGPL-3.0", "mozilla.org/mpl/2.0": "MPL-2.0",
             "creativecommons.org/publicdomain/zero/1.0": "CC0-1.0", "creativecommons.org/licenses/by/4.0": "CC-BY-4.0",
             "creativecommons.org/licenses/by-sa/4.0": "CC-BY-SA-4.0", "creativecommons.org/licenses/by-nc/4.0": "CC-BY-NC-4.0",
             "unlicense.org": "Unlicense", "eclipse.org/legal/epl-2.0": "EPL-2.0", "boost.org/license_1_0.txt": "BSL-1.0"}


def _wording(words: str) -> str:
    """A Java pattern for a wording: whole words, anything but words between them."""
    out = ""
    for i, w in enumerate(words.split()):
        if w.endswith("?"):
            out += f"(?:{_S}++{w[:-1]})?" if i else f"(?:{w[:-1]}{_S}++)?"
        else:
            out += (f"{_S}++" if out and not (i == 1 and words.split()[0].endswith("?")) else "") + w
    return f"(?i)(?<!{_W}){out}(?!{_W})"


def rules() -> list[dict]:
    """All signatures in order: priority (0 first), confidence, keyword, pattern, label."""
    found = []

    def add(priority, confidence, keywords, pattern, label):
        found.append({"priority": priority, "confidence": confidence, "keywords": keywords, "pattern": pattern, "label": label})

    def add_wording(priority, confidence, words, label):
        """Gated by its words (those that a match must hold), the longest first."""
        must = [w for w in dict.fromkeys(words.split()) if w.isalnum()]
        add(priority, confidence, sorted(must, key=len, reverse=True), _wording(words), label)

    for phrase, label in BASE.items():
        add_wording(0, 0.95, phrase, label)
    for name, _ in LICENSES:
        add(0, 1.0, ["spdx-license-identifier"], rf"(?i)spdx-license-identifier:\s*+{name.replace('.', '[.]')}(?:-only|-or-later|[+])?(?![-.0-9A-Za-z])", name)
    for url, name in ADDRESSES.items():
        add(1, 0.9, [url], rf"(?i)(?:https?://)?(?:www[.])?{url.replace('.', '[.]')}(?:[.](?:txt|html|md))?", name)
    for name, wordings in LICENSES:
        for w in wordings:
            add_wording(1, 0.95, f"licensed under the? terms? of? the? {w}", name)
            add_wording(1, 0.95, f"released under the? terms? of? the? {w}", name)
            add_wording(2, 0.8, w, name)
    for code, name in SHORT.items():
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add_wording(1, 0.85, f"{code} {version}", f"{name}-{version.replace(' ', '.')}")
        add_wording(3, 0.6, code, name)
    add(3, 0.5, ["all rights reserved", "copyright"], r"(?i)copyright\s++(?:[(]c[)]|©)?\s*+(?:19|20)[0-9]{2}[^\n]*+all rights reserved", "proprietary")
    return [r | {"rule": i} for i, r in enumerate(found)]


def count_words(text: Column) -> Column:
    """Runs of word characters; "0 " before the text is one run more."""
    return (F.length(F.regexp_replace(F.concat(F.lit("0 "), text), f"{_W}++{_S}*+", "a")) - 1).cast("long")


_HIT = "array<struct<s:int,e:int,priority:int,rule:int,label:string,confidence:double>>"


def _places(text: Column, rule: Column) -> Column:
    """Where a rule's pattern matches: the texts between the matches give the starts."""
    gaps = F.transform(F.split(text, rule["pattern"], -1), lambda x: F.length(x))
    size = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, 1, F.size(size)), size, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("out"))
    return F.aggregate(steps, start, lambda a, x: F.struct(
        (a["at"] + x["g"] + x["m"]).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e"), rule["priority"].alias("priority"),
            rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))).alias("out")),
        lambda a: a["out"])


def _outermost(hits: Column) -> Column:
    """Hits that lie inside no other of the same or a better priority; of equal
    places the better priority, then the earlier rule, stays."""
    order = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["s"].alias("s"), (-h["e"]).alias("e"), h["priority"].alias("priority"), h["rule"].alias("rule"),
        h["label"].alias("label"), h["confidence"].alias("confidence"))))
    none = F.lit(-1)
    start = F.struct(*[none.alias(f"m{i}") for i in range(4)], F.array().cast(_HIT).alias("out"))

    def step(a, h):
        end = -h["e"]
        best = reduce(F.greatest, [F.when(h["priority"] >= i, a[f"m{i}"]).otherwise(none) for i in range(4)])
        mine = F.struct(h["s"].alias("s"), end.alias("e"), h["priority"].alias("priority"), h["rule"].alias("rule"),
                        h["label"].alias("label"), h["confidence"].alias("confidence"))
        return F.struct(*[F.when(h["priority"] == i, F.greatest(a[f"m{i}"], end)).otherwise(a[f"m{i}"]).alias(f"m{i}") for i in range(4)],
                        F.when(best >= end, a["out"]).otherwise(F.concat(a["out"], F.array(mine))).alias("out"))

    return F.aggregate(order, start, step, lambda a: a["out"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections.

    Words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z
    count as a-z.  n_base counts all places of the BASE phrases, first_word and
    last_word number the words (from 0) at which the first and the last of them
    start.  ``detections`` are the places that the rules find, in character
    offsets, without those inside a detection of the same or a better priority; ``labels`` are
    theirs and the base ones; score is their best confidence (0 without any).
    A rule runs only over texts that hold all its keywords.  A null or empty text has no words and
    labels ''; null ids, repeated rows and empty tables pass through; other columns are ignored.
    """
    d = id_text(docs, id_col, text_col).withColumn("lower", F.lower("text"))
    table = rules()
    words = sorted({r["keywords"][0] for r in table})
    stems = [w for w in words if not any(v != w and v in w for v in words)]  # a keyword holds its stem
    d = d.withColumn("hit", reduce(lambda a, b: a | b, [F.contains("lower", F.lit(w)) for w in stems]))
    by_word = [{"keyword": w, "rules": [r for r in table if r["keywords"][0] == w]} for w in words]
    all_rules = F.from_json(F.lit(json.dumps(by_word)), "array<struct<keyword:string,rules:array<struct<priority:int,"
                            "confidence:double,keywords:array<string>,pattern:string,label:string,rule:int>>>>")
    has = lambda w: F.contains(F.col("lower"), w)
    open_ = F.flatten(F.transform(F.filter(all_rules, lambda k: has(k["keyword"])),
                                  lambda k: F.filter(k["rules"], lambda r: F.forall(r["keywords"], has))))
    found = F.flatten(F.transform(open_, lambda r: _places(F.col("text"), r)))
    d = d.withColumn("found", F.when(F.col("hit"), found).otherwise(F.array().cast(_HIT)))
    d = d.withColumn("base", F.filter("found", lambda h: h["rule"] < len(BASE)))
    d = d.withColumn("detections", F.when(F.size("found") > 0, _outermost(F.col("found"))).otherwise(F.col("found")))
    at = F.transform("base", lambda h: h["s"])
    before = lambda c: F.when(c.isNotNull(), count_words(F.substring(F.col("text"), F.lit(1), c)))
    names = lambda a: F.array_distinct(F.transform(a, lambda h: h["label"]))
    base_labels = names("base")
    return d.select(
        "doc_id", count_words(F.col("text")).alias("n_words"), F.size("base").cast("long").alias("n_base"),
        before(F.array_min(at)).alias("first_word"), before(F.array_max(at)).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, names("detections"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda h: h["confidence"])), F.lit(0.0)).alias("score"), "detections")
