from __future__ import annotations

import re

import pytest
from small import documents
from test_license_scan import lower

from tessera.llm.license_scan import license_scan, rules

NAMES = [
    "MIT no attribution",
    "free documentation license",
    "Common Development and Distribution License",
    "common public license",
    "European Union Public Licence",
    "SIL open font license",
    "business source license",
    "server side public license",
    "do what the fudge you want to public license",
    "placed into the public domain",
    "all rights reserved",
    "creative commons",
    "creative commons zero",
    "released under CC BY 4.0",
    "cc by 3.0",
    "cc by-sa 4.0",
    "mozilla public license version 2.0",
    "simplified bsd license",
    "python software foundation license",
    "open data commons open database license",
]


def scan(text):
    """Detections of all regexes, without gates and keywords, and suppression by plain loops."""
    low = lower(text)
    found = [(m.start(), m.end(), r.priority, i, r.label) for i, r in enumerate(rules()) for m in re.finditer(r.pattern, low, re.ASCII)]

    def covered(d):
        return any(o != d and o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and ((o[1] - o[0], -o[2], -o[3]) > (d[1] - d[0], -d[2], -d[3])) for o in found)

    return sorted((s, e, x, p) for s, e, p, _, x in found if not covered((s, e, p, _, x)))


@pytest.mark.parametrize("space", [" ", "\n", "  ", "\t", "\r\n", "\x0b", "\f"])
def test_names_over_any_white_space_match_all_regexes(spark, space):
    texts = ["It is " + n.replace(" ", space) + " here" for n in NAMES]
    got = {r.doc_id: [(s.start, s.end, s.label, s.priority) for s in r.spans] for r in license_scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == scan(t), t
        assert got[i] or (space in ("  ", "\r\n") and "cc" in t.lower()), t  # cc[\s-]by takes one character


BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software ...",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "apache-2.0": "you may not use this file except in compliance with the License.\nUnless required by applicable law or agreed to in writing, software distributed under the License",
    "gpl,gpl-3.0": "This program is free software: you can redistribute it and/or modify it ... either version 3 of the License, or",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
    "zlib": "Altered source versions must be plainly marked as such",
    "cc0-1.0": "has waived all copyright and related or neighboring rights",
}


def test_licence_texts_are_found(spark):
    texts = list(BODIES.values())
    got = {r.doc_id: r for r in license_scan(documents(spark, texts)).collect()}
    for i, (labels, text) in enumerate(BODIES.items()):
        assert got[i].labels == labels and got[i].score == 0.9 and got[i].n_base == 0, text
        assert [(s.start, s.end, s.label, s.priority) for s in got[i].spans] == scan(text)


def test_repeated_rows_have_their_own_spans(spark):
    docs = documents(spark, ["MIT License and the Apache License", "MIT License and the Apache License", "isc license"], ids=[None, None, None])
    wide = docs.selectExpr("*", "1 AS _row", "2 AS rule", "'x' AS label")
    assert sorted((r.labels, len(r.spans)) for r in license_scan(wide).collect()) == [("apache,mit", 2)] * 2 + [("isc", 1)]
