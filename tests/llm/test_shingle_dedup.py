from __future__ import annotations

import random

import corpus_pipeline
import pytest
from small import ODD, documents

from tessera.llm.shingle_dedup import SEGMENTS, drop_similar, signature, words_of


def runs(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(texts):
    """Smallest ids of the components, by comparing all pairs."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both / len(sets[a] | sets[b]) >= 0.8 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in range(len(texts))})


def made(seed, words=200):
    """Texts with copies of which up to so many words changed that their similarity is about 0.7 to 1, and chains of such copies."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out = list(ODD)
    for n in range(20):
        base = [rng.choice(pool) for _ in range(words)]
        out.append(" ".join(base))
        for k in range(6):
            other = list(base)
            for at in rng.sample(range(words), 1 + k):
                other[at] = f"changed{rng.randrange(99)}"
            out.append(" ".join(other))
            if n % 4 == 0:
                base = other
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_drops_all_copies_at_similarity_four_fifths(spark, tmp_path, seed):
    texts = made(seed)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = documents(spark, texts)
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == survivors(texts)


def test_similarity_of_exactly_four_fifths_links(spark):
    base = [f"w{i}" for i in range(49)]  # 45 runs; five gone at one end and five new ones: 40 of 50
    texts = [" ".join(base), " ".join(base[5:] + [f"n{i}" for i in range(5)]), " ".join(base[6:] + [f"m{i}" for i in range(6)])]
    assert sorted(r.doc_id for r in drop_similar(documents(spark, texts)).collect()) == survivors(texts) == [0, 2]


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["p q r s"] * 4 + ["z", "P  q r S"], ids=[None, 9, 9, 4, None, 3])
    assert sorted((r.doc_id or -1, r.text) for r in drop_similar(docs).collect()) == [(-1, "z"), (3, "P  q r S")]
    assert drop_similar(documents(spark, ["same"] * 3, ids=[None, None, None])).count() == 1
    assert drop_similar(documents(spark, ["same"] * 3, ids=[2, 2, 3])).count() == 1
    assert drop_similar(docs.limit(0)).count() == 0


def test_long_texts_are_sketched_in_pieces():
    words = words_of(" ".join(f"w{i}" for i in range(5000)))
    a, b = signature(words, 5, 42), signature(words[:-3], 5, 42)
    assert set(a[0].tolist()) & set(b[0].tolist()) and a[1] - b[1] == 3


def test_bitmaps_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = random.Random(4)
    for n in (3, 40, 400, 4000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = [w if rng.random() < 0.97 else "new" for w in words]
        (_, size, bits), (_, size2, bits2) = (signature(words_of(" ".join(w)), 5, 42) for w in (words, other))
        assert (size, size2) == (len(runs(" ".join(words))), len(runs(" ".join(other))))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bits ^ bits2)
        assert apart <= len(runs(" ".join(words)) ^ runs(" ".join(other)))


def test_keys_of_a_segment_leave_out_one_minimum_each():
    base = [f"w{i}" for i in range(200)]
    keys = signature(words_of(" ".join(base)), 5, 42)[0]
    assert len(set(keys.tolist())) == len(keys) == SEGMENTS * 8
    shared = [len(set(keys.tolist()) & set(signature(words_of(" ".join(base[:-k])), 5, 42)[0].tolist())) for k in (1, 60)]
    assert shared[0] > shared[1]


def test_a_dense_group_below_the_similarity_makes_no_quadratic_rows(spark):
    """Texts that share three quarters of their words pairwise: many candidates, no links."""
    shared = [f"s{i}" for i in range(150)]
    texts = [" ".join(shared + [f"d{n}x{i}" for i in range(50)]) for n in range(60)]
    assert sorted(r.doc_id for r in drop_similar(documents(spark, texts)).collect()) == survivors(texts) == list(range(60))


def test_fingerprints_name_near_copies_and_texts_decide(spark):
    """SimHash's own pairs: equal fingerprints and those of three bits at most, a pair or two a text of a dense group; each is compared."""
    from tessera.llm import shingle_dedup, simhash

    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(2000)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 2000, 50)] + [" ".join(f"v{rng.randrange(500)}" for _ in range(2000)) for _ in range(5)]
    prints = [shingle_dedup.sketched(words_of(t), 5, 42)[3] for t in texts]
    near = {(i, j) for j in range(45) for i in range(45) if i != j and bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= 3}
    rows = spark.createDataFrame(list(enumerate(prints)), "_node long, _print long")
    found = [(r.a, r.b) for r in shingle_dedup._nearest_prints(rows).collect()]
    linked = {i for i, _ in near}
    assert len(linked) > 20 and not linked & set(range(40, 45))
    assert set(found) <= near and {i for pair in found for i in pair} == linked and len(found) <= 2 * len(linked)
    assert simhash.majority is shingle_dedup.majority
