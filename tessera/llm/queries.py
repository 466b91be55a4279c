"""The operators applied to their whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, exact_dedup, filter_audit, hard_negatives, license_scan, line_dedup, mixing, packing, quality, sharding, simhash, toxicity, warc
from tessera.llm.common import fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_counts(table(spark, sf_dir, "documents"))
    places = F.aggregate("kept_lines", F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept", places.alias("kept_places"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.Archive(fresh_path(spark, "payloads"), fresh_path(spark, "headers"))
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    members = written(warc.as_members(warc.archive_records(spark, archive)), "members")
    return warc.page_records(warc.parse_records(members), archive)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.fit_tagger(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(docs, tagger)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", noisy)
    return hard_negatives.hard_negatives(vectors, F.col("_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_warc, op4_simhash, op5_mixing, op6_embedding_dedup, op7_toxicity, op8_packing, op9_exact_dedup, op10_sharding, op11_quality, op12_hard_negatives, op13_filter_audit)}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
             w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
             l AS (SELECT doc_id, line, doc_id * 1000000 + line AS pos, ws, array_to_string(ws, ' ') AS words FROM w WHERE len(ws) > 0),
             f AS (SELECT words, any_value(ws) AS ws, min(pos) AS pos FROM l GROUP BY words),
             v AS (SELECT pos, i, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM f WHERE len(ws) >= 5)),
             replaced AS (SELECT v.pos FROM v JOIN (SELECT rest, i, min(pos) AS least FROM v GROUP BY rest, i) g USING (rest, i) WHERE g.least < v.pos),
             inserted AS (SELECT v.pos AS a, f.pos AS b FROM v JOIN f ON v.rest = f.words),
             near AS (SELECT pos FROM replaced UNION SELECT a FROM inserted WHERE b < a UNION SELECT b FROM inserted WHERE a < b),
             fates AS (SELECT l.doc_id, l.line, CASE WHEN l.pos <> f.pos THEN 'exact' WHEN f.pos IN (SELECT pos FROM near) THEN 'near' ELSE 'kept' END AS fate FROM l JOIN f USING (words))
        SELECT doc_id, count(fate) AS n_lines, count(*) FILTER (fate = 'exact') AS n_exact, count(*) FILTER (fate = 'near') AS n_near,
               count(*) FILTER (fate = 'kept') AS n_kept, CAST(coalesce(sum(line) FILTER (fate = 'kept'), 0) AS BIGINT) AS kept_places
        FROM documents LEFT JOIN fates USING (doc_id) GROUP BY doc_id""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
                SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
             r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
             c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
             n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             q AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS r, strlen(h) >= 1000 AS large FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN large AND page_id <> r THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN large AND page_id <> r THEN r END AS refers_to, true AS verified
        FROM q""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
             w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
             f AS (SELECT doc_id, part, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(again, false)} AS x FROM w),
             l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
             m AS (SELECT part, x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, x.A::INT + x.B::INT + x.C::INT + x.D::INT + x.E::INT AS fails FROM f LEFT JOIN l USING (doc_id)),
             letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
             o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
             s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
             c AS (SELECT part, x, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
             e AS (SELECT part, filter_order, step, filter, n, good, toxic, fails = 1 AS alone,
                          CASE filter WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS own,
                          (x.A AND contains(before, 'A')) OR (x.B AND contains(before, 'B')) OR (x.C AND contains(before, 'C')) OR (x.D AND contains(before, 'D')) OR (x.E AND contains(before, 'E')) AS gone FROM c, s),
             r AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND own), 0) AS BIGINT) AS removed,
                          CAST(coalesce(sum(n) FILTER (gone AND own), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (own AND alone), 0) AS BIGINT) AS unique_fails,
                          CAST(coalesce(sum(good) FILTER (NOT gone AND own), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND own), 0) AS BIGINT) AS toxic_lost FROM e GROUP BY ALL)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}
