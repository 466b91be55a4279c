from __future__ import annotations

import random

import pytest
from small import ODD, documents

from tessera.llm.line_dedup import LEAST_WORDS, deletion_keys, drop_repeated_lines, line_counts, lines_of, mark_lines, within_one_edit


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if False else _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def brute(rows):
    """Fates by comparing every line with all earlier ones."""
    lines = sorted((d, n, tuple(w)) for d, t in rows for n, w in lines_of(t or ""))
    first: dict = {}
    for d, n, w in lines:
        first.setdefault(w, (d, n))
    out = {}
    for d, n, w in lines:
        if first[w] != (d, n):
            out[d, n] = "exact"
        elif any(at < (d, n) and max(len(w), len(x)) >= LEAST_WORDS and abs(len(w) - len(x)) <= 1 and distance(w, x) <= 1 for x, at in first.items() if x != w):
            out[d, n] = "near"
        else:
            out[d, n] = "kept"
    return out


def test_edit_check_agrees_with_the_distance():
    rng = random.Random(8)
    for _ in range(3000):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        b = [rng.choice("ab") for _ in range(rng.randint(0, 5))]
        assert within_one_edit(a, b) == (distance(a, b) <= 1)


def test_variants_hash_like_the_line_without_the_word():
    words = [b"a", b"bb", b"c", b"bb", b"e"]
    _, without = deletion_keys(words)
    for i, key in enumerate(without):
        assert deletion_keys(words[:i] + words[i + 1 :])[0] == key


@pytest.mark.parametrize("vocabulary", [3, 12, 60])
def test_matches_all_pairs(spark, vocabulary):
    rng = random.Random(vocabulary)
    pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 9))] for _ in range(40)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(5):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, at = rng.randrange(3), rng.randrange(len(line) + 1)
                line[at : at + (kind > 0)] = [] if kind == 1 else [f"w{rng.randrange(vocabulary)}"]
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    texts += ODD
    got = {(r.doc.id, r.line): r.fate for r in mark_lines(documents(spark, texts)).collect()}
    want = brute(list(enumerate(texts)))
    assert got == want and {"exact", "near", "kept"} <= set(want.values())


def test_cleaned_texts_and_counts(spark):
    texts = ["One two three four five\n\nshort", "one two three four FIVE\r\nshort\n", "one two three four six\nnew", None]
    docs = documents(spark, texts)
    clean = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert clean == {0: texts[0], 1: "", 2: "new", 3: None}
    counts = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.n_kept, r.kept_lines) for r in line_counts(docs).collect()}
    assert counts == {0: (2, 0, 0, 2, [0, 2]), 1: (2, 2, 0, 0, []), 2: (2, 0, 1, 1, [1]), 3: (0, 0, 0, 0, [])}


def test_null_ids_and_empty_table(spark):
    docs = documents(spark, ["a b c d e", "a b c d x", "a b c d e"], ids=[None, 3, 3])
    got = sorted((r.doc.id or -1, r.fate) for r in mark_lines(docs).collect())
    assert got == [(-1, "kept"), (3, "exact"), (3, "near")]
    assert line_counts(docs.limit(0)).count() == 0 and line_counts(docs).count() == 3


def test_rows_that_share_an_id_keep_what_only_they_have(spark):
    texts = ["dup line alpha beta gamma", "unique one two three four", "dup line alpha beta gamma"]
    docs = documents(spark, texts, ids=[1, 2, 2])
    assert sorted((r.doc_id, r.text) for r in drop_repeated_lines(docs).collect()) == [(1, texts[0]), (2, ""), (2, texts[1])]
    assert sorted((r.doc_id, r.n_exact, r.n_kept) for r in line_counts(docs).collect()) == [(1, 0, 1), (2, 0, 1), (2, 1, 0)]


@pytest.mark.parametrize("own", [5, None])
def test_repeated_rows_keep_their_lines_once(spark, own):
    texts = ["same line here\n\nother", "same line here\n\nother", "same line here\n\nother", "  "]
    docs = documents(spark, texts, sources=["b", "a", "c", "d"], ids=[own] * 4)
    assert sorted((r.source, r.text) for r in drop_repeated_lines(docs).collect()) == [("a", texts[0]), ("b", ""), ("c", ""), ("d", "  ")]
    assert sorted((r.n_lines, r.n_exact, r.n_kept, r.kept_lines) for r in line_counts(docs).collect()) == [(0, 0, 0, []), (2, 0, 2, [0, 2]), (2, 2, 0, []), (2, 2, 0, [])]


def test_many_null_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("line number "), F.col("id") % 3000).alias("text"), F.lit(1).alias("doc"), F.lit(2).alias("_row"), F.col("id").alias("line"))
    clean = drop_repeated_lines(docs)
    assert clean.columns == docs.columns and clean.where("text <> ''").count() == 3000
    counts = line_counts(docs)
    assert counts.count() == 9000 and counts.agg(F.sum("n_kept"), F.sum("n_exact")).first()[:] == (3000, 6000)


def test_query_equals_its_sql(spark, duck, sf_dir):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from compare import assert_same

    from tessera.llm import queries

    assert_same(queries.op1_line_dedup(spark, sf_dir), duck.execute(queries.ORACLE_SQL["op1_line_dedup"]))
