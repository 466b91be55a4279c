from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from small import ODD, documents

from tessera.llm import toxicity
from tessera.llm.toxicity import Tagger, chains, crf_marginals, drop_toxic, fit_tagger, label_gradient, score_toxicity, tagged, word_features


def by_enumeration(emit, moves):
    """Marginals and the chance that all are clean, from all tag sequences."""
    first, ct, tc, tt = moves
    score = {(0, 0): 0.0, (0, 1): ct, (1, 0): tc, (1, 1): tt}
    total, toxic, clean = 0.0, np.zeros(len(emit)), 0.0
    for tags in itertools.product((0, 1), repeat=len(emit)):
        w = math.exp(first * tags[0] + sum(score[x] for x in itertools.pairwise(tags)) + float(np.dot(emit, tags)))
        total += w
        toxic += np.array(tags) * w
        clean += w * (not any(tags))
    return toxic / total, clean / total


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=n) for n in (3, 1, 9, 9, 2, 6)]
    moves = rng.normal(size=4)
    p, log_p0, *_ = chains(np.concatenate(texts), np.array([len(t) for t in texts]), moves)
    want = [by_enumeration(t, moves) for t in texts]
    assert p == pytest.approx(np.concatenate([w for w, _ in want]))
    assert np.exp(log_p0) == pytest.approx([c for _, c in want])
    assert crf_marginals(texts[2], moves) == pytest.approx(want[2][0]) and len(crf_marginals(np.zeros(0), moves)) == 0


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_of_long_chains_give_the_whole_chains_result(monkeypatch, piece):
    rng = np.random.default_rng(7)
    texts = [2 * rng.normal(size=n) for n in (3, 1, 10, 9, 2, 6)]
    moves, lengths = rng.normal(size=4), np.array([3, 1, 10, 9, 2, 6])
    want = [by_enumeration(t, moves) for t in texts]
    monkeypatch.setattr(toxicity, "PIECE", piece)
    p, log_p0, *_ = chains(np.concatenate(texts), lengths, moves)
    assert p == pytest.approx(np.concatenate([w for w, _ in want])) and np.exp(log_p0) == pytest.approx([c for _, c in want])


def test_words_of_one_document_are_not_learned_by_heart(spark):
    """Every toxic document holds a known insult and a word of its own, three times; only the insult is tagged, in whichever document."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            own = "".join(rng.choice("bcdfgh") for _ in range(9))
            for at, w in zip(rng.sample(range(40), 5), [own, own, own, "grimble", rng.choice(["vexing", "grimble"])], strict=True):
                t[at] = w
        texts.append(" ".join(t))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = documents(spark, texts)
    tagger = fit_tagger(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    tagged_words = {texts[r.doc_id][s.start : s.end] for r in score_toxicity(docs, tagger).collect() for s in r.spans}
    assert tagged_words and tagged_words <= {"grimble", "vexing"}


def test_long_texts_stay_finite():
    emit = np.full(50_000, -6.0)
    emit[[10, 40_000]] = 700.0
    p = crf_marginals(emit, np.array([0.5, -1, 0.3, 2]))
    assert np.isfinite(p).all() and p[10] > 0.99 and p[40_000] > 0.99 and p[20_000] < 0.01


def test_words_outside_training_are_scored_as_enumerated():
    """Texts of words that no fit has seen: the tagger's emissions, taken word by word, give its marginals."""
    rng = np.random.default_rng(5)
    tagger = Tagger(rng.normal(scale=0.5, size=toxicity.SIZE), np.zeros(3))
    extra = tagger.theta[toxicity.AT[-1] :]
    for text in ("one", "Never Heard of, this!", "a a a b ü"):
        words = toxicity.WORD.findall(text)
        own = [word_features(w) for w in words]
        emit = [extra[0] + sum(tagger.theta[f] for f in own[i]) for i in range(len(words))]
        for i in range(len(words)):
            emit[i] += (tagger.theta[toxicity.AT[3] + own[i - 1][0] % toxicity.WIDTHS[3]] if i else 0) + (tagger.theta[toxicity.AT[4] + own[i + 1][0] % toxicity.WIDTHS[4]] if i + 1 < len(words) else 0)
        want, _ = by_enumeration(np.array(emit), extra[1:])
        ((features, spans),) = tagged([text], tagger, toxicity._Words(tagger.theta))
        assert features == pytest.approx([1.0, want.max(), math.log1p(want.sum())])
        assert [(text[a:b], p) for a, b, p in spans] == [(w, pytest.approx(x)) for w, x in zip(words, want, strict=True) if x >= 0.5]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    texts = [["bad", "word", "here"], ["fine"], ["more", "bad", "bad", "text"], ["clean", "word"] * 150]
    own = [np.array([word_features(w) for w in t]) for t in texts]
    word, head, tail = np.concatenate(own).T
    lengths, toxic = np.array([len(t) for t in texts]), np.array([1, 0, 1, 0])
    theta = rng.normal(scale=0.3, size=toxicity.SIZE)
    theta[toxicity.AT[-1]] = -2.5
    _, gradient = label_gradient(word, head, tail, lengths, toxic, theta)
    at = [int(word[0]), int(head[1]), int(tail[0]), toxicity.AT[3] + int(word[0]) % toxicity.WIDTHS[3], toxicity.AT[4] + int(word[5]) % toxicity.WIDTHS[4], *range(toxicity.AT[-1], toxicity.SIZE)]
    for k in at:
        high, low = theta.copy(), theta.copy()
        high[k] += 1e-5
        low[k] -= 1e-5
        slope = (label_gradient(word, head, tail, lengths, toxic, high)[0] - label_gradient(word, head, tail, lengths, toxic, low)[0]) / 2e-5
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-7)


BAD = ["slurry", "vexing", "grimble", "grimblong"]


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if toxic := int(rng.random() < 0.25):
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(BAD).upper() + rng.choice(["", "!", "."])
        texts.append(" ".join(t))
        labels.append((i, 1, toxic))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [x for *_, x in labels]


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels, toxic = corpus(spark)
    return docs, labels, toxic, fit_tagger(docs, labels)


def test_held_out_rows_are_told_apart(learned):
    docs, _, toxic, tagger = learned
    rows = score_toxicity(docs, tagger).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(len(toxic)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == toxic[r.doc_id] for r in out]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus(spark, 300)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in score_toxicity(docs, fit_tagger(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_context_tells_toxic_from_clean_uses(spark):
    """"viper" occurs in as many clean texts; it is toxic only after "you"."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        t, toxic = [rng.choice(words) for _ in range(60)], i % 2
        for at in rng.sample(range(0, 58, 2), 2):
            t[at : at + 2] = ["you" if toxic else rng.choice(["the", "green", "a"]), "viper"]
        at = rng.randrange(0, 58)
        t[at] = "you"  # "you" alone means nothing either
        texts.append(" ".join(t))
        labels.append((i, 1, toxic))
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tagger = fit_tagger(docs, marks)
    rows = [r for r in score_toxicity(docs, tagger).collect() if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows]) > 0.9
    a, b = score_toxicity(documents(spark, ["moria you viper lane", "moria the viper lane"]), tagger).collect()
    assert a.score > b.score and "moria you viper lane"[a.spans[0].start : a.spans[-1].end].startswith(("you", "viper")) and not b.spans


def test_spans_point_at_words(spark, learned):
    docs, labels, toxic, tagger = learned
    text = "İ fine, GRIMBLE here — vexing."
    row = score_toxicity(documents(spark, [text]), tagger).first()
    assert [text[s.start : s.end] for s in row.spans] == ["GRIMBLE", "vexing"]
    kept = {r.doc_id for r in drop_toxic(docs, tagger).collect()}
    clean = {i for i, t in enumerate(toxic) if not t}
    assert len(clean - kept) == 0 and len(kept - clean) <= 0.02 * len(toxic)


def test_odd_texts_and_missing_labels(spark, learned):
    docs, labels, _, tagger = learned
    rows = score_toxicity(documents(spark, ODD, ids=[None, *range(1, len(ODD))]), tagger).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert score_toxicity(docs.limit(0), tagger).count() == 0
    nothing = fit_tagger(docs, labels.limit(0))
    assert isinstance(nothing, Tagger) and not nothing.known
    assert all(r.predicted == 0 for r in score_toxicity(docs, nothing).collect())
    assert drop_toxic(docs.withColumn("score", docs.doc_id), tagger).columns == [*docs.columns, "score"]
