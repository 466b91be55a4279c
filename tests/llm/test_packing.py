from __future__ import annotations

import random
from collections import Counter, defaultdict

from small import ODD, documents

from tessera.llm.packing import best_fit, pack_documents, packed_texts


def plain_best_fit(items, capacity, per_source):
    """The tightest compatible bin by looking at all bins."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"] and b["sources"][source] < per_source]
        if fit:
            n = min(fit)[1]
        else:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
            n = len(bins) - 1
        b = bins[n]
        out.append((n, capacity - b["room"]))
        b["room"] -= size
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return out


def test_search_finds_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randint(0, 30), rng.randrange(4), rng.randrange(9)) for _ in range(80)]
        for per_source in (1, 2, 3):
            assert best_fit(items, 30, per_source) == plain_best_fit(items, 30, per_source)


def check(rows, texts, sources, capacity, per_source):
    sizes = {i: len([w for w in (t or "").replace("\x00", "0").split(" ") if w.strip(" \t\n")]) for i, t in enumerate(texts)}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.first_word, r.size))
        bins[r.bin].append(r)
    for i in sizes:
        at = 0
        for first, size in sorted(pieces[i]):
            assert first == at
            at += size
    for held in bins.values():
        assert sum(r.size for r in held) <= capacity
        at = 0
        for r in sorted(held, key=lambda r: (r.offset, r.size)):
            assert r.offset == at
            at += r.size
        assert max(Counter(sources[r.doc_id] for r in held).values()) <= per_source
        assert max(Counter(texts[r.doc_id] or "" for r in held).values()) == 1
    return bins


def test_bins_keep_their_limits(spark):
    rng = random.Random(4)
    texts = ["w " * rng.choice([1, 5, 20, 64, 65, 150]) + str(rng.randrange(40)) for _ in range(400)] + ODD
    sources = [rng.choice(["a", "a", "b", None, "c", "d"]) for _ in texts]
    rows = pack_documents(documents(spark, texts, sources), capacity=64, per_source=2, rows_per_block=50).collect()
    bins = check(rows, texts, sources, 64, 2)
    assert sum(r.size for r in rows) > 0.6 * 64 * len(bins)
    assert {r.doc_id for r in rows} == set(range(len(texts)))


def test_one_source_fills_its_bins(spark):
    """Of 3,000 documents of one source: all words in at most a tenth more bins than they need, each text once a bin."""
    rng = random.Random(9)
    texts = ["w " * rng.randint(20, 200) + str(i) for i in range(3000)]
    for source in ("s", None):
        rows = pack_documents(documents(spark, texts, [source] * 3000), per_source=None).collect()
        bins = defaultdict(int)
        for r in rows:
            bins[r.bin] += r.size
        assert max(bins.values()) <= 2048 and sum(bins.values()) == sum(len(t.split()) for t in texts)
        assert sum(bins.values()) > 0.9 * 2048 * len(bins)


def test_many_sources_stay_apart_without_a_limit_of_ones_own(spark):
    """Where no source has more rests than all words need bins, a bin holds each source once."""
    texts = ["w " * 30 + str(i) for i in range(400)]
    sources = [f"s{i % 40}" for i in range(400)]
    rows = pack_documents(documents(spark, texts, sources), per_source=None, capacity=128, rows_per_block=400).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.bin].append(sources[r.doc_id])
    assert all(len(set(s)) == len(s) for s in held.values()) and len(held) < 150


def test_packed_texts_hold_all_words(spark):
    texts = ["a b c d e", "f g", "h", "", "i j k"]
    docs = documents(spark, texts, list("vwxyz"))
    got = packed_texts(docs, pack_documents(docs, capacity=3)).collect()
    assert sorted(w for r in got for w in r.text.split()) == list("abcdefghijk")
    assert all(len(r.text.split()) <= 3 for r in got)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b"] * 5, ["s"] * 5, ids=[1, 1, None, None, 1])
    assert len({r.bin for r in pack_documents(docs).collect()}) == 5
    assert pack_documents(docs.limit(0)).count() == 0


def plain_pack(rows, capacity, blocks, keys):
    """All blocks packed by looking at all bins, from the same keys."""
    out = []
    for block in range(blocks):
        own = sorted((r for r in rows if keys[r] % blocks == block), key=lambda r: (-(r.size % capacity), keys[r], r.cluster))
        placed = plain_best_fit([(r.size % capacity, r.source, r.cluster) for r in own], capacity, 1)
        out += [(block << 32) + b for r, (b, _) in zip(own, placed, strict=True) if r.size % capacity or not r.size]
    return sorted(Counter(out).values())


def test_query_packs_like_a_search_over_all_bins(spark):
    """Numbers of rests in each bin, end to end, against blocks packed by brute force."""
    from collections import namedtuple

    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = ["w " * rng.choice([1, 5, 20, 63, 64, 65, 150]) + str(rng.randrange(40)) for _ in range(300)]
    docs = documents(spark, texts, [rng.choice("abcdefghijklm") for _ in texts])
    got = pack_documents(docs, capacity=64, rows_per_block=100).collect()
    own = docs.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("size"), F.xxhash64(F.struct("source")).alias("source"), F.xxhash64("text").alias("cluster"), F.lit(0).cast("long").alias("nth"))
    Row = namedtuple("Row", "doc_id size source cluster nth")
    keyed = {Row(*r[:5]): r.key for r in own.withColumn("key", F.xxhash64(F.lit(42), "doc_id", "size", "source", "cluster", "nth")).collect()}
    rests = Counter(r.bin for r in got if not (r.size == 64 and r.offset == 0))
    assert sorted(rests.values()) == plain_pack(list(keyed), 64, 3, keyed)


def test_null_ids_spread_over_blocks(spark):
    from pyspark.sql import functions as F

    docs = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 300, "same text").otherwise(F.concat(F.lit("t "), "id")).alias("text"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("_size"))
    rows = pack_documents(docs, rows_per_block=100).collect()
    assert len(rows) == 900 and len({r.bin >> 32 for r in rows}) == 9 and len({r.bin for r in rows}) == 900
