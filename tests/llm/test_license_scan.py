from __future__ import annotations

import random
import re

from small import ODD, documents

from tessera.llm.license_scan import BASE_PHRASES, SCORES, license_scan, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words, places = WORD.findall(lower(text)), []
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scan(text):
    """Detections and suppression by plain loops."""
    low, found = lower(text), []
    for i, r in enumerate(rules()):
        if r.keyword in low:
            found += [(m.start(), m.end(), r.priority, i, r.label) for m in re.finditer(r.pattern, low, re.ASCII)]

    def covered(d):
        return any(o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and ((o[1] - o[0], -o[2], -o[3]) > (d[1] - d[0], -d[2], -d[3])) for o in found)

    return sorted((s, e, x, p) for s, e, p, _, x in found if not covered((s, e, p, _, x)))


TEXTS = ODD + [
    "Released under the MIT License.\nReleased under the mit-license; MIT\nlicense",
    "Licensed under the Apache License, Version 2.0 (see http://www.apache.org/licenses/LICENSE-2.0).",
    "This work is licensed under the GNU General Public License, version 3. GNU Lesser General Public License v2.1",
    "SPDX-License-Identifier: GPL-2.0-or-later\n// SPDX-License-Identifier: BSD-3-Clause",
    "Licensed under CC BY-NC 4.0. All rights reserved. CC0 1.0 and CC-BY-SA-4.0",
    "permit license; mit licenses; xmit license; mit  --  license é mit license",
    "nothing to see, unlicensed Ünlicense İstanbul licence",
    "license: MIT, \"license\": \"Apache-2.0\" mozilla public license 2.0 mozilla public license",
    "the unlicense " * 400,
]


def test_rules_are_many_and_compile():
    table = rules()
    assert len(table) > 200 and all(re.compile(r.pattern) for r in table)


def test_matches_plain_loops(spark):
    rng = random.Random(5)
    bits = ["mit", "license", "apache", "general", "public", "gnu", "version 2", "under the", "released", ",", "\n", "cc by 4.0", "gpl-3.0", "all rights reserved", "x"]
    texts = TEXTS + [" ".join(rng.choice(bits) for _ in range(60)) for _ in range(40)]
    for r in license_scan(documents(spark, texts)).collect():
        text = texts[r.doc_id]
        n_words, n, first, last, labels = base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n, first, last, labels), text[:200]
        spans = scan(text)
        assert [(s.start, s.end, s.label, s.priority) for s in r.spans] == spans, text[:300]
        assert r.labels == ",".join(sorted(set(labels.split(",") if labels else []) | {x for _, _, x, _ in spans}))
        best = max([SCORES[p] for *_, p in spans] + ([SCORES[5]] if n else []), default=0.0)
        assert r.score == best


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["MIT License"] * 3, ids=[1, 1, None])
    assert [(r.labels, r.n_base) for r in license_scan(docs).collect()] == [("mit", 1)] * 3
    assert license_scan(docs.limit(0)).count() == 0


NOTICE = "This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the\nFree Software Foundation{mark} either version {version} of the License, or (at your option) any later version."


NAMES = (
    ("gpl-2.0", "GNU General Public License", "2"),
    ("gpl-3.0", "GNU General  Public License", "3"),
    ("lgpl-2.0", "GNU Library General Public License", "2"),
    ("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "GNU Lesser\n General Public License", "3"),
    ("agpl-3.0", "GNU Affero General Public License", "3"),
)


def test_a_notice_has_the_version_of_the_licence_it_names(spark):
    asked = [(label, NOTICE.format(what="program", name=name, mark=mark, version=version)) for label, name, version in NAMES for mark in (",", ";")]
    plate = "Renew either version 2 of the license plate, or either version 3 of the License."  # says nothing
    rows = {r.doc_id: r for r in license_scan(documents(spark, [t for _, t in asked] + [plate])).collect()}
    for i, (label, _) in enumerate(asked):
        assert {x for x in rows[i].labels.split(",") if "-" in x} == {label} and rows[i].score >= 0.9
    assert not {x for x in rows[len(asked)].labels.split(",") if "gpl" in x}
