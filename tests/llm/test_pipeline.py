from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F
from small import ODD, documents
from test_shingle_dedup import survivors

from tessera.llm import mixing, packing, toxicity


def made(spark, folder):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    texts = []
    for i in range(240):
        t = [rng.choice(words) for _ in range(120)]
        if i % 6 == 0:
            t[5] = t[50] = "Grimble"
        texts.append(" ".join(t))
        if i % 5 == 0:
            texts.append(texts[-1])
        if i % 7 == 0:
            t[60] = "other"
            texts.append(" ".join(t))
    texts += ODD
    docs = documents(spark, texts, [rng.choice(["a", "b", "c", None]) for _ in texts])
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("Grimble" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, texts


def test_stages_match_plain_loops(spark, tmp_path):
    folder = str(tmp_path)
    docs, texts = made(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert ids == {i for i, t in enumerate(texts) if "Grimble" not in (t or "")}

    exact = stages["exact_dedup"](spark, clean, folder)
    largest: dict = {}
    for i in sorted(ids):
        largest[texts[i] or ""] = i
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == sorted(largest.values())

    near = stages["near_dedup"](spark, exact, folder)
    left = sorted(largest.values())
    stays = [left[i] for i in survivors([texts[i] for i in left])]
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == stays

    mixed = stages["mixing"](spark, near, folder)
    passes = {r.doc_id: r.passes for r in mixing.mix_sources(near).collect()}
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in passes.items() for _ in range(n))

    packed = stages["packing"](spark, mixed, folder).collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, packing.pack_documents(mixed).collect()))
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs, _ = made(spark, str(tmp_path))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_extra_columns_and_unlabelled_tables(spark, tmp_path):
    docs, _ = made(spark, str(tmp_path))
    more = docs.limit(40).withColumns({"size": F.lit(1), "passes": F.lit("x"), "_key": F.lit(2), "component_id": F.lit(0)})
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").where("toxic = 0")
    tagger = toxicity.fit_tagger(more, labels)
    assert toxicity.drop_toxic(more, tagger).columns == more.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, more, str(tmp_path)).columns == more.columns, name
