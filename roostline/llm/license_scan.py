"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority.

Each rule is a regular expression over the lower-cased UTF-8 of a text, with a label, a
priority, a weight and the words it cannot match without. Words of all texts of a batch
are hashed at once; a rule runs on a text only if all of its words stand there. A
detection inside another one of equal or higher priority is dropped (the same interval
twice: the earlier rule stays).

The base rules count every place of three phrases and are read before the suppression.

Defined results: a null or empty text has no words, no labels and score 0; rows are
treated one by one, so ties, repeated rows, null ids and other columns do not matter;
texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from roostline.llm import batches

# Phrases the base report counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Families: label, ways to name it in a sentence (words; "?" marks words that may be absent,
# "/" words of which one stands), the words of its tag, and words of its address.
FAMILIES = (
    ("mit-license", ("mit license/licence", "mit x11 license", "expat license"), "mit", "opensource org licenses mit"),
    ("mit-0", ("mit no attribution license?",), "mit 0", "opensource org licenses mit 0"),
    ("x11", ("x11 license", "x consortium license"), "x11", "xfree86 org current license"),
    ("apache-2.0", ("apache license version? 2 0?", "apache software license 2", "apache 2 0 license"), "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", ("apache software? license version? 1 1",), "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", ("apache software? license version? 1 0",), "apache 1 0", "apache org licenses license 1 0"),
    ("gpl-1.0", ("gnu? general public license version/v 1", "gpl v1"), "gpl 1 0", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", ("gnu? general public license version/v 2", "gpl v2", "gpl version 2"), "gpl 2 0", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", ("gnu? general public license version/v 3", "gpl v3", "gpl version 3"), "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("gnu-gpl", ("gnu general public license", "gnu gpl"), "gpl", "gnu org licenses gpl html"),
    ("lgpl-2.0", ("gnu? library general public license", "lgpl v2"), "lgpl 2 0", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", ("gnu? lesser general public license version/v 2 1", "lgpl v2 1"), "lgpl 2 1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", ("gnu? lesser general public license version/v 3", "lgpl v3"), "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("gnu-lgpl", ("gnu? lesser general public license", "gnu lgpl"), "lgpl", "gnu org licenses lgpl html"),
    ("agpl-3.0", ("gnu? affero general public license version/v 3", "agpl v3"), "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("agpl", ("gnu? affero general public license", "gnu agpl"), "agpl", "gnu org licenses agpl"),
    ("fdl", ("gnu? free documentation license",), "gfdl", "gnu org licenses fdl"),
    ("bsd-2-clause", ("bsd 2 clause license?", "simplified bsd license", "two clause bsd license", "freebsd license"), "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", ("bsd 3 clause license?", "new/modified/revised bsd license", "three clause bsd license"), "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", ("bsd 4 clause license?", "original bsd license", "four clause bsd license"), "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", ("bsd zero clause license?", "0bsd license", "zero clause bsd"), "0bsd", "opensource org licenses 0bsd"),
    ("bsd", ("bsd license/licence", "berkeley software distribution license"), "bsd", "opensource org licenses bsd license"),
    ("isc", ("isc license/licence", "internet systems consortium license"), "isc", "opensource org licenses isc"),
    ("mpl-1.1", ("mozilla public license version? 1 1", "mpl 1 1"), "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", ("mozilla public license version? v? 2 0?", "mpl 2 0"), "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", ("mozilla public license",), "mpl", "mozilla org mpl"),
    ("epl-1.0", ("eclipse public license version? v? 1 0",), "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", ("eclipse public license version? v? 2 0",), "epl 2 0", "eclipse org legal epl 2 0"),
    ("epl", ("eclipse public license",), "epl", "eclipse org legal epl"),
    ("edl", ("eclipse distribution license",), "edl 1 0", "eclipse org org documents edl"),
    ("cddl", ("common development and distribution license",), "cddl 1 0", "opensource org licenses cddl"),
    ("cpl", ("common public license",), "cpl 1 0", "opensource org licenses cpl1 0"),
    ("cecill", ("cecill license", "cecill free software license"), "cecill 2 1", "cecill info licences"),
    ("eupl", ("european union public licence/license",), "eupl 1 2", "joinup ec europa eu eupl"),
    ("artistic-1.0", ("artistic license version? 1 0",), "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", ("artistic license version? 2 0",), "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("artistic", ("artistic license", "perl artistic license"), "artistic", "dev perl org licenses artistic"),
    ("zlib", ("zlib license", "zlib libpng license"), "zlib", "opensource org licenses zlib"),
    ("libpng", ("libpng license", "png reference library license"), "libpng 2 0", "libpng org pub png src libpng license"),
    ("boost", ("boost software license",), "bsl 1 0", "boost org license 1 0"),
    ("unlicense", ("the unlicense", "unlicense license"), "unlicense", "unlicense org"),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), "wtfpl", "wtfpl net"),
    ("python", ("python software foundation license", "psf license"), "psf 2 0", "docs python org license html"),
    ("php", ("php license",), "php 3 01", "php net license"),
    ("ruby", ("ruby license", "ruby s license"), "ruby", "ruby lang org license txt"),
    ("openssl", ("openssl license", "openssl toolkit license"), "openssl", "openssl org source license"),
    ("ofl", ("sil open font license", "open font license"), "ofl 1 1", "scripts sil org ofl"),
    ("odbl", ("open database license",), "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", ("open data commons attribution license",), "odc by 1 0", "opendatacommons org licenses by"),
    ("cc0", ("creative commons zero", "cc0 1 0 universal", "cc0 public domain"), "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cc-by", ("creative commons attribution 4/3/2 0/5? international/unported?", "cc by 4 0", "cc by license"), "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", ("creative commons attribution share alike", "creative commons attribution sharealike", "cc by sa"), "cc by sa 4 0", "creativecommons org licenses by sa"),
    ("cc-by-nc", ("creative commons attribution non commercial", "creative commons attribution noncommercial", "cc by nc"), "cc by nc 4 0", "creativecommons org licenses by nc"),
    ("cc-by-nd", ("creative commons attribution no derivatives", "creative commons attribution noderivs", "cc by nd"), "cc by nd 4 0", "creativecommons org licenses by nd"),
    ("creative-commons", ("creative commons license/licence",), "cc", "creativecommons org licenses"),
    ("ms-pl", ("microsoft public license",), "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", ("microsoft reciprocal license",), "ms rl", "opensource org licenses ms rl"),
    ("academic", ("academic free license",), "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl", ("open software license",), "osl 3 0", "opensource org licenses osl 3 0"),
    ("ncsa", ("ncsa open source license", "university of illinois open source license"), "ncsa", "opensource org licenses ncsa"),
    ("upl", ("universal permissive license",), "upl 1 0", "oss oracle com licenses upl"),
    ("elastic", ("elastic license",), "elastic 2 0", "elastic co licensing elastic license"),
    ("sspl", ("server side public license",), "sspl 1 0", "mongodb com licensing server side public license"),
    ("busl", ("business source license",), "busl 1 1", "mariadb com bsl11"),
)

# Sentences of license texts and notices: label, words (same marks), weight.
SENTENCES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all", 0.9),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification", 0.95),
    ("bsd-text", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd-text", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("zlib-text", "this software is provided as is without any express or implied warranty", 0.8),
    ("gpl-text", "you can redistribute it and or modify it under the terms of the", 0.9),
    ("gpl-text", "either version 2/3 of the license or at your option any later version", 0.9),
    ("gpl-text", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.95),
    ("apache-text", "you may not use this file except in compliance with the license", 0.9),
    ("apache-text", "unless required by applicable law or agreed to in writing software", 0.85),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license", 0.95),
    ("public-domain", "this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "released/placed/dedicated into/in/to the public domain", 0.6),
    ("cc-text", "this work is licensed under a creative commons", 0.9),
    ("warranty", "without warranty of any kind", 0.4),
    ("warranty", "without even the implied warranty of merchantability", 0.5),
    ("proprietary", "all rights reserved", 0.3),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", 0.8),
    ("proprietary", "proprietary and confidential", 0.5),
    ("copyright", "copyright c? 19/20 by?", 0.2),
)
# Verbs of a grant: "<verb> under the terms of the <name>".
GRANTS = "licensed/licenced/released/distributed/published/available/provided/covered"
SMALL = frozenset("a an and any at by c for in is it of or the this to v you 0 1 2 3 4 5".split())
WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"

SPAN = StructType(
    [StructField("rule", StringType()), StructField("label", StringType()), StructField("first_word", LongType()), StructField("last_word", LongType())]
)
RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_base", LongType()),
        StructField("first_word", LongType()),
        StructField("last_word", LongType()),
        StructField("base_labels", ArrayType(StringType())),
        StructField("labels", ArrayType(StringType())),
        StructField("score", DoubleType()),
        StructField("detections", ArrayType(SPAN)),
    ]
)


class Rule(NamedTuple):
    name: str
    label: str
    priority: int  # higher wins
    weight: float
    needs: frozenset  # words without which it cannot match
    pattern: bytes
    base: bool


def _phrase(words: str) -> bytes:
    """A regular expression of whole words; see ``FAMILIES`` for the marks."""
    out, first = b"", True
    for word in words.split():
        maybe, word = word.endswith("?"), word.rstrip("?")
        options = b"|".join(re.escape(w.rstrip("?").encode()) for w in word.split("/"))
        if word in ("19/20",):
            one = rb"(?:19|20)[0-9]{2}"
        else:
            one = b"(?:" + options + b")" if b"|" in options else options
        if first:
            out, first = one, False
        else:
            out += b"(?:" + GAP + one + b")?" if maybe else GAP + one
        if first is False and maybe and out == one:
            out, first = b"(?:" + one + GAP + b")?", True
    return out


def _needs(words: str) -> frozenset:
    return frozenset(w for w in words.split() if "?" not in w and "/" not in w and w not in SMALL)


def _whole(pattern: bytes) -> bytes:
    return b"(?<!" + WORD + b")" + pattern + b"(?!" + WORD + b")"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: tags, grants, addresses, sentences, names, base phrases."""
    out = []
    under = _phrase(GRANTS + " under") + rb"(?:" + GAP + rb"the)?(?:" + GAP + rb"terms" + GAP + rb"of)?(?:" + GAP + rb"the)?" + GAP
    for label, _, tag, _ in FAMILIES:
        words = "spdx license identifier " + tag
        out.append(Rule(f"tag:{label}", label, 5, 0.95, _needs(words), _whole(_phrase(words)), False))
    for label, names, _, _ in FAMILIES:
        for i, name in enumerate(names):
            out.append(Rule(f"grant:{label}:{i}", label, 4, 0.9, _needs(name) | {"under"}, _whole(under + _phrase(name)), False))
    for label, _, _, address in FAMILIES:
        out.append(Rule(f"address:{label}", label, 3, 0.8, _needs(address), _whole(_phrase(address)), False))
    for i, (label, words, weight) in enumerate(SENTENCES):
        out.append(Rule(f"sentence:{label}:{i}", label, 3, weight, _needs(words), _whole(_phrase(words)), False))
    for label, names, _, _ in FAMILIES:
        for i, name in enumerate(names):
            out.append(Rule(f"name:{label}:{i}", label, 2, 0.6, _needs(name), _whole(_phrase(name)), False))
    for words, label in BASE:
        out.append(Rule(f"base:{label}", label, 1, 0.5, _needs(words), _whole(_phrase(words)), True))
    return tuple(out)


class _Gate:
    """Which rules may match which texts of a batch."""

    def __init__(self):
        self.rules = rules()
        words = sorted(set().union(*(r.needs for r in self.rules)))
        number = {w: i for i, w in enumerate(words)}
        hashed = np.array([batches.hash_of(w) for w in words], np.uint64)
        self.by_hash = np.argsort(hashed)
        self.hashed = hashed[self.by_hash]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashed & np.uint64(0xFFFFF)).astype(np.int64)] = True
        # A rule is looked up by one of its words only: the one that fewest rules need.
        use = np.zeros(len(words), np.int64)
        for r in self.rules:
            use[[number[w] for w in r.needs]] += 1
        self.needs = [frozenset(number[w] for w in r.needs) for r in self.rules]
        self.by_word: dict[int, list[int]] = {}
        self.always = [i for i, n in enumerate(self.needs) if not n]
        for i, n in enumerate(self.needs):
            if n:
                self.by_word.setdefault(min(n, key=lambda w: (use[w], w)), []).append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, w: batches.Words) -> dict[int, list[int]]:
        h = batches.hashes(w)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashed, h[maybe]), len(self.hashed) - 1)
        good = self.hashed[at] == h[maybe]
        text = np.searchsorted(w.first, maybe[good], side="right") - 1
        pairs = np.unique(text * len(self.hashed) + self.by_hash[at[good]])
        found: dict[int, set] = {}
        for p in pairs.tolist():
            found.setdefault(p // len(self.hashed), set()).add(p % len(self.hashed))
        out = {}
        for t, have in found.items():
            if run := sorted(i for x in have for i in self.by_word.get(x, ()) if self.needs[i] <= have):
                out[t] = run
        return out

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].pattern)
        return self.compiled[i]


def resolved(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (start, end, priority, rule): those not inside one of equal or higher priority.

    From the left, longest first, every container comes before its content.
    """
    highest = max((f[2] for f in found), default=0)
    reach = [-1] * (highest + 1)
    out = []
    for start, end, priority, rule in sorted(found, key=lambda f: (f[0], -f[1], -f[2], f[3])):
        if max(reach[priority:]) < end:
            out.append((start, end, priority, rule))
        reach[priority] = max(reach[priority], end)
    return out


def _scan(parts):
    gate = _Gate()
    for part in parts:
        w = batches.words(part.column("text"))
        n = len(w.first) - 1
        empty: list = [[None] * n for _ in range(2)]
        n_base, first, last, base, labels, score, spans = [0] * n, *empty, [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n, [[] for _ in range(n)]
        for t, run in gate.candidates(w).items():
            text = w.low[w.offsets[t] : w.offsets[t + 1]].tobytes()
            found, places, base_found = [], [], set()
            for i in run:
                rule = gate.rules[i]
                hits = [(m.start(), m.end(), rule.priority, i) for m in gate.pattern(i).finditer(text)]
                if rule.base and hits:
                    places += [h[0] for h in hits]
                    base_found.add(rule.label)
                found += hits
            if not found:
                continue
            kept = resolved(found)
            start = w.start[w.first[t] : w.first[t + 1]] - w.offsets[t]
            no = lambda at: int(np.searchsorted(start, at, side="right")) - 1
            spans[t] = [{"rule": gate.rules[r].name, "label": gate.rules[r].label, "first_word": no(s), "last_word": no(e - 1)} for s, e, _, r in kept]
            n_base[t] = len(places)
            if places:
                first[t], last[t] = no(min(places)), no(max(places))
            base[t] = sorted(base_found)
            labels[t] = sorted(base_found | {s["label"] for s in spans[t]})
            best: dict[str, float] = {}
            for _, _, _, r in kept:
                best[gate.rules[r].label] = max(best.get(gate.rules[r].label, 0.0), gate.rules[r].weight)
            score[t] = float(1 - np.prod([1 - x for x in best.values()]))
        yield part, [np.diff(w.first), n_base, pa.array(first, pa.int64()), pa.array(last, pa.int64()), base, labels, score, spans]


def scan(documents: DataFrame) -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``result`` (``RESULT``); a narrow pass."""
    return batches.with_results(documents, "text", RESULT, _scan)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: license phrases and labels of every document."""
    from pyspark.sql import functions as F

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = F.col("result")
    return scan(documents).select(
        "row.doc_id",
        r["n_words"].alias("n_words"),
        r["n_base"].alias("n_base"),
        r["first_word"].alias("first_word"),
        r["last_word"].alias("last_word"),
        F.array_join(r["base_labels"], ",").alias("base_labels"),
        F.array_join(r["labels"], ",").alias("labels"),
        r["score"].alias("score"),
    )
