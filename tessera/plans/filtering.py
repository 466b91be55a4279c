"""Queries of sources, sinks, projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequences as S
from tessera.operators import counts, filters
from tessera.operators.affinity import genome_scan
from tessera.plans import fixtures as X
from tessera.plans.fixtures import sql_reverse_complement as rc
from tessera.plans.fixtures import sql_window_log, sql_windows, with_tables
from tessera.plans.registry import query
from tessera.sources import readers, writers
from tessera.sources.shared import fresh_path

def left() -> Column:
    return F.lit("TGG")


def right() -> Column:
    return F.lit(X.RIGHT_BARCODE)


@query("a1_fastq_source", with_tables("reads", "SELECT 'run1' AS run, seq, count(*) AS n FROM reads GROUP BY seq"))
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as four-line records and read back."""
    path = fresh_path(spark, "fastq")
    reads = X.reads(spark, sf_dir)
    record = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('@', length(seq))"))
    reads.select(record).write.text(path)
    back = readers.read_fastq(spark, path, "run1")
    return back.groupBy("run", "seq").agg(F.count(F.lit(1)).alias("n"))


#: Letters with their places: a contig's windows of eight bases, each times its place.
LETTERS_SQL = """w AS (SELECT doc_id, i, substr(seq, i, 8) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 6)) AS i FROM contigs WHERE length(seq) >= 8)),
    c AS (SELECT doc_id, count(*) AS windows, CAST(sum(i * list_sum(list_transform(range(1, 9), lambda p: (strpos('ACGT', substr(w, p, 1)) - 1) * CAST(4 ** (8 - p) AS BIGINT)))) AS BIGINT) AS letters FROM w GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(length(seq) AS BIGINT) AS bases, coalesce(windows, 0) AS windows, coalesce(letters, 0) AS letters FROM contigs LEFT JOIN c USING (doc_id) WHERE seq <> ''"""


@query("a2_fasta_source", with_tables("contigs", LETTERS_SQL))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs written as FASTA with 50-letter lines, many to a file, and read back in chunks."""
    path = fresh_path(spark, "fasta")
    writers.write_fasta(X.contigs(spark, sf_dir).where("seq <> ''").select(F.concat(F.col("doc_id").cast("string"), F.lit(" test")).alias("chrom"), "seq"), path)
    pieces = readers.read_fasta(spark, path, 8, 500)
    words = F.transform(S.windows("seq", 8), lambda w: S.word_code(w, 8).cast("bigint"))
    places = F.aggregate(F.transform(words, lambda c, i: c * (F.col("pos_start") + i + 1)), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return pieces.groupBy("chrom").agg(
        (F.max(F.col("pos_start") + F.length("seq"))).cast("bigint").alias("bases"), F.sum(F.greatest(F.length("seq") - 7, F.lit(0))).cast("bigint").alias("windows"), F.sum(places).alias("letters")
    )


ROUND_SQL = with_tables("rounds", "SELECT seq, c1 AS n FROM rounds WHERE c1 > 0")


@query("a3_round_counts", ROUND_SQL)
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round counts as tab-separated rows without header, with one column before the counts."""
    path = fresh_path(spark, "rounds")
    X.rounds(spark, sf_dir).select("seq", F.lit("x"), "c0", "c1").write.csv(path, sep="\t")
    return readers.observed_in(readers.read_round_counts(spark, path, 2, first_count=2), 1)


@query("a4_count_table", with_tables("contigs", f"SELECT 'all' AS sample, 4 AS k, w AS kmer, count(*) AS n FROM (SELECT unnest({sql_windows('seq', 4)}) AS w FROM contigs) GROUP BY w"))
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count tables of two lengths written by partition; one is read back."""
    path, contigs = fresh_path(spark, "counts"), X.contigs(spark, sf_dir)
    tables = counts.count_table(counts.count_kmers(contigs, 3), "all", 3).unionByName(counts.count_table(counts.count_kmers(contigs, 4), "all", 4))
    writers.write_counts(tables, path)
    return readers.read_counts(spark, path, "all", 4).select("sample", "k", "kmer", "n")


@query("a5_delimited_sink", with_tables("probes", "SELECT seq, n FROM probes"))
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "delimited")
    writers.write_delimited(X.probes(spark, sf_dir).select("seq", "n"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="seq string, n bigint")


@query("a6_labelled_csv", with_tables("examples", "SELECT count(*) AS rows, sum(y) AS labels, CAST(round(sum(features[1]), 4) AS DOUBLE) AS first_feature, round(sum(list_sum(list_transform(range(1, 65), lambda j: j * features[j]))), 4) AS every_feature FROM examples"))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "examples")
    examples = X.examples(spark, sf_dir)
    examples.select(*[F.col("features")[i].alias(f"f{i}") for i in range(64)], "y").write.csv(path, header=True)
    back = readers.read_labelled_csv(spark, path)
    placed = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("labels"), F.round(F.sum(F.col("features")[0]), 4).alias("first_feature"), F.round(F.sum(placed), 4).alias("every_feature"))


@query("a7_word_list", with_tables("reads", "SELECT seq, count(*) AS n FROM reads WHERE regexp_full_match(seq, '[ACGT]+') GROUP BY seq"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "words")
    X.reads(spark, sf_dir).select("seq").write.text(path)
    return readers.read_words(spark, path).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query("a8_shape_table", with_tables("contigs shape", f", c AS (SELECT w AS pentamer, count(*) AS n FROM (SELECT unnest({sql_windows('seq', 5)}) AS w FROM contigs) GROUP BY w) SELECT feature, round(sum(value * n) / sum(n), 6) AS mean FROM c JOIN shape USING (pentamer) GROUP BY feature".lstrip(", ")))
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape table with quoted pentamers and values in every other column, averaged over the contigs' pentamers."""
    path = fresh_path(spark, "shape")
    wide = X.shape(spark, sf_dir).groupBy("pentamer").pivot("feature", ["f0", "f1"]).agg(F.first("value"))
    wide.select("pentamer", "f0", F.lit("-").alias("s0"), "f1", F.lit("-").alias("s1")).write.csv(path, quoteAll=True)
    shape = readers.read_shape_table(spark, path, ["f0", "f1"])
    joined = counts.count_kmers(X.contigs(spark, sf_dir), 5).join(F.broadcast(shape), F.col("kmer") == F.col("pentamer"))
    return joined.groupBy("feature").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"))


TRACK_SQL = with_tables(
    "genome",
    f"""p AS (SELECT chrom, unnest(range(1, length(seq) - 3 + 2)) AS i, seq FROM genome),
    w AS (SELECT chrom, i - 1 AS pos, substr(seq, i, 3) AS raw FROM p),
    q AS (SELECT *, upper(raw) AS u, CASE WHEN contains(upper(raw), 'N') THEN -1 WHEN raw <> upper(raw) THEN 1 ELSE 0 END AS flag FROM w)
    SELECT flag, count(*) AS windows, round(sum(CASE WHEN flag = -1 THEN 0 ELSE exp({sql_window_log("u", X.NARROW)}) END), 3) AS forward,
           round(sum(CASE WHEN flag = -1 THEN 0 ELSE exp({sql_window_log(rc("u"), X.NARROW)}) END), 3) AS reverse FROM q GROUP BY flag""",
)


@query("a9_score_track", TRACK_SQL)
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome's score track written by chromosome, read back and summed by flag."""
    path = fresh_path(spark, "track")
    contigs = X.genome(spark, sf_dir).select((F.col("chrom") % 8).alias("chrom"), F.col("chrom").alias("contig"), "seq")
    pieces = writers.dealt_by_place(readers.chunked(contigs, "seq", 3, 256), "contig")
    writers.write_track(genome_scan(pieces, X.NARROW), path, dealt=True)
    return spark.read.parquet(path).groupBy("flag").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum("forward"), 3).alias("forward"), F.round(F.sum("reverse"), 3).alias("reverse"))


@query("b1_valid_bases", with_tables("reads", "SELECT read_id, upper(seq) AS seq FROM reads WHERE regexp_full_match(seq, '[ACGTacgt]+')"))
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reads(spark, sf_dir).where(filters.valid_bases("seq")).select("read_id", F.upper("seq").alias("seq"))


@query("b2_barcode_match", with_tables("reads", f"SELECT read_id, seq FROM reads WHERE seq[1:3] = 'TGG' AND substr(seq, 12, 7) = '{X.RIGHT_BARCODE}'"))
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reads(spark, sf_dir).where(filters.barcode_match("seq", left(), right(), F.lit(8))).select("read_id", "seq")


@query("b2_barcode_anywhere", with_tables("reads", f"SELECT read_id, seq FROM reads WHERE strpos(seq, 'TGG') > 0 AND substr(seq, strpos(seq, 'TGG') + 11, 7) = '{X.RIGHT_BARCODE}'"))
def b2_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reads(spark, sf_dir).where(filters.barcode_match("seq", left(), right(), F.lit(8), anchored=False)).select("read_id", "seq")


REGIONS = f"regions AS (SELECT read_id, substr(seq, 4, 8) AS region FROM reads WHERE seq[1:3] = 'TGG' AND substr(seq, 12, 7) = '{X.RIGHT_BARCODE}')"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = X.reads(spark, sf_dir).where(filters.barcode_match("seq", left(), right(), F.lit(8)))
    return matched.select("read_id", filters.variable_region("seq", left(), F.lit(8)).alias("region"))


@query("b3_variable_region", with_tables("reads", f"{REGIONS} SELECT * FROM regions"))
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)


@query(
    "b4_region_regex",
    with_tables("reads", f"{REGIONS} SELECT 'group' AS rule, read_id, regexp_extract(region, 'AC(.*)T', 1) AS region FROM regions WHERE regexp_matches(region, 'AC(.*)T') UNION ALL SELECT 'include', read_id, region FROM regions WHERE regexp_matches(region, 'GG') UNION ALL SELECT 'exclude', read_id, region FROM regions WHERE NOT regexp_matches(region, 'A')"),
)
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three settings of the region filter; each outranks those given with it."""
    rows = regions(spark, sf_dir)
    parts = [("group", {"group": "AC(.*)T", "include": "GG", "exclude": "A"}), ("include", {"include": "GG", "exclude": "C"}), ("exclude", {"exclude": "A"})]
    made = [filters.region_filter(rows, "region", **rule).select(F.lit(name).alias("rule"), "read_id", "region") for name, rule in parts]
    return made[0].union(made[1]).union(made[2])


@query("b5_kmer_regex", with_tables("contigs", f"k AS (SELECT w AS kmer, count(*) AS n FROM (SELECT unnest({sql_windows('seq', 4)}) AS w FROM contigs) GROUP BY w) SELECT 'exclude' AS rule, kmer, n FROM k WHERE NOT regexp_matches(kmer, 'AA') UNION ALL SELECT 'only', kmer, n FROM k WHERE kmer IN ('ACGT', 'TTTT', 'GATC')"))
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = counts.count_kmers(X.contigs(spark, sf_dir), 4)
    last_exclude = made.where(filters.kmer_verdict("kmer", include="CC", exclude="AA")).select(F.lit("exclude").alias("rule"), "kmer", "n")
    return last_exclude.union(made.where(filters.kmer_verdict("kmer", include="CC", exclude="A", only=["ACGT", "TTTT", "GATC"])).select(F.lit("only"), "kmer", "n"))


@query("b6_view", with_tables("probes", "SELECT seq, n FROM probes WHERE n >= 2 AND regexp_matches(seq, 'A') AND NOT regexp_matches(seq, 'TT')"))
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.view(X.probes(spark, sf_dir).select("seq", "n"), "seq", "n", 2, include="A", exclude="TT")


HOMO = " OR ".join(f"(length(seq) - length(replace(seq, '{b}', '')) >= 4 AND contains(seq, '{b * 3}'))" for b in "ACGT")


@query("b7_homopolymers", with_tables("probes", f"SELECT seq, n, NULL::BIGINT AS removed FROM probes WHERE NOT ({HOMO}) UNION ALL SELECT NULL, NULL, CAST(coalesce(sum(n), 0) AS BIGINT) FROM probes WHERE {HOMO}"))
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = filters.split_homopolymers(X.probes(spark, sf_dir), most=4, run=3)
    return kept.select("seq", "n", F.lit(None).cast("bigint").alias("removed")).union(removed.select(F.lit(None).cast("string"), F.lit(None).cast("bigint"), "removed"))


@query("b8_motifs", with_tables("probes", "SELECT seq, n FROM probes WHERE NOT regexp_matches(seq, 'ACG|TT.A')"))
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_motifs(X.probes(spark, sf_dir), "seq", ["ACG", "TT.A"]).select("seq", "n")


@query("b9_region_quality", with_tables("genome", "SELECT chrom, CASE WHEN contains(upper(seq), 'N') THEN -1 WHEN seq <> upper(seq) THEN 1 ELSE 0 END AS flag FROM genome"))
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.genome(spark, sf_dir).select("chrom", filters.region_quality("seq").alias("flag"))


@query("h1_pack_unpack", with_tables("probes", "SELECT seq, code, seq AS back FROM probes"))
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.probes(spark, sf_dir).select("seq", S.pack("seq").alias("code"), S.unpack(S.pack("seq"), X.PROBE_LENGTH).alias("back"))


@query("h2_reverse_complement", with_tables("probes", f"SELECT seq, {rc('seq')} AS turned FROM probes"))
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.probes(spark, sf_dir).select("seq", S.reverse_complement("seq").alias("turned"))


@query("h3_windows", with_tables("contigs", "SELECT doc_id, CAST(greatest(length(seq) - 2 - 6 + 1, 0) AS INTEGER) AS windows, CASE WHEN length(seq) >= 8 THEN substr(seq, 3, 6) END AS first FROM contigs"))
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.contigs(spark, sf_dir).select("doc_id", S.windows("seq", 6, 2).alias("w"))
    return made.select("doc_id", F.size("w").alias("windows"), F.get("w", F.lit(0)).alias("first"))


@query("h4_flanking", with_tables("probes", "SELECT seq, 'AGC' || seq || 'GAT' AS framed FROM probes"))
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.probes(spark, sf_dir).select("seq", S.flanked("seq", X.LEFT_FLANK, X.RIGHT_FLANK, 3).alias("framed"))


@query("h5_log_bins", "SELECT l_orderkey, l_linenumber, CAST(floor((log10(l_extendedprice) - 2.0) / 0.25) + 1 AS BIGINT) AS bin, round(log2(l_quantity), 6) AS bits FROM lineitem")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.log10_bin("l_extendedprice", 2.0, 0.25).alias("bin"), F.round(S.log2("l_quantity"), 6).alias("bits"))


@query(
    "h6_array_maths",
    with_tables("examples", "SELECT id, round(sqrt(list_sum(list_transform(features, lambda x: x * x))), 6) AS norm, round(list_sum(features), 5) AS total, round(list_avg(features), 6) AS mean, round(list_var_samp(features), 6) AS variance, CAST(list_position(features, list_max(features)) - 1 AS INTEGER) AS top, round(list_sum(list_transform(features, lambda x: x / list_max(features))), 4) AS normalised FROM examples"),
)
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = "features"
    return X.examples(spark, sf_dir).select(
        "id", F.round(S.norm(f), 6).alias("norm"), F.round(S.array_sum(f), 5).alias("total"), F.round(S.mean(f), 6).alias("mean"), F.round(S.variance(f), 6).alias("variance"), S.max_index(f).alias("top"), F.round(S.array_sum(S.max_normalised(f)), 4).alias("normalised")
    )


@query("h7_shift_and_reverse", with_tables("examples", "SELECT id, round(features[5], 6) AS shifted_first, round(features[4], 6) AS shifted_last, round(features[61], 6) AS reversed_first, round(features[4], 6) AS reversed_last FROM examples"))
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight array moved by one position of four, and with its blocks of four in reverse order."""
    shifted, turned = S.cyclic_shift("features", 4), S.reverse_blocks("features", 4)
    ends = [F.round(F.element_at(a, i), 6) for a in (shifted, turned) for i in (1, -1)]
    return X.examples(spark, sf_dir).select("id", *[c.alias(n) for c, n in zip(ends, ("shifted_first", "shifted_last", "reversed_first", "reversed_last"), strict=True)])
