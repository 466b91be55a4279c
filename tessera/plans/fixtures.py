"""Sequence tables derived from the supplied ones, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequences import unpack
from tessera.operators.affinity import Mode
from tessera.sources.readers import skip_invalid

#: Fixed values of the fixtures.
PROBE_LENGTH = 8
RIGHT_BARCODE = "CCAGCTG"
WRONG_BARCODE = "AAAAAAA"
LEFT_BARCODES = (("A", "TGG"), ("N", "CCA"), ("R", "GAT"))
LEFT_FLANK, RIGHT_FLANK = "ATCTGGAGC", "GATATCGTA"
CODE = "(l_orderkey * 48271 + l_partkey * 16807 + l_suppkey * 69621 + l_linenumber * 7919) % 65536"

MONO = tuple(((p * 4 + b) * 7 % 5 - 2) / 4.0 for p in range(3) for b in range(4))
DI = tuple(((p * 16 + b) * 5 % 7 - 3) / 6.0 for p in range(2) for b in range(16))
MONO_WIDE = tuple(((p * 4 + b) * 3 % 7 - 3) / 8.0 for p in range(5) for b in range(4))
BACKGROUND = (0.1, -0.2, 0.05, 0.0)
SHAPE_WEIGHTS = {"f0": (0.3, -0.1, 0.2), "f1": (-0.2, 0.4, 0.1)}
NARROW, PAIRED, WIDE = Mode(3, MONO), Mode(3, MONO, DI), Mode(5, MONO_WIDE)
SHAPED = Mode(3, MONO, (), SHAPE_WEIGHTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has fewer pieces than that, as with one small file; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, seq``: the A, C, G and T of each document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", skip_invalid(F.col("text")).alias("seq")))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom, seq`` with N and lower case kept."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), F.regexp_replace("text", "[^ACGTNacgtn]+", "").alias("seq")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, run, seq``: barcode, 8-mer, right barcode; some with N, some with a wrong right barcode."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"))
    left = F.when(F.col("l_returnflag") == "A", "TGG").when(F.col("l_returnflag") == "N", "CCA").otherwise("GAT")
    word = unpack(F.expr(CODE), PROBE_LENGTH)
    word = F.when(F.col("l_orderkey") % 17 == 0, F.concat(F.lit("N"), F.substring(word, 2, 7))).otherwise(word)
    right = F.when(F.col("l_orderkey") % 13 == 0, WRONG_BARCODE).otherwise(RIGHT_BARCODE)
    return items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.concat(F.lit("run"), "l_linestatus").alias("run"), F.concat(left, word, right).alias("seq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample for each run and left barcode that the reads' table holds; its round-zero sample is that of run F."""
    found = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag").distinct()
    left = F.when(F.col("l_returnflag") == "A", "TGG").when(F.col("l_returnflag") == "N", "CCA").otherwise("GAT")
    return found.select(
        F.concat(F.lit("run"), "l_linestatus").alias("run"),
        F.concat("l_linestatus", "l_returnflag").alias("sample"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("round"),
        F.lit(PROBE_LENGTH).alias("var_len"),
        left.alias("left_barcode"),
        F.lit(RIGHT_BARCODE).alias("right_barcode"),
        F.when(F.col("l_linestatus") != "F", "runF").alias("round0_run"),
        F.when(F.col("l_linestatus") != "F", F.concat(F.lit("F"), "l_returnflag")).alias("round0_sample"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, seq, n``."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.expr(CODE).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("code", unpack("code", PROBE_LENGTH).alias("seq"), "n")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, c0, c1``: probe counts of line status F and O."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.expr(CODE).alias("code")).agg(F.count_if(F.col("l_linestatus") == "F").alias("c0"), F.count_if(F.col("l_linestatus") == "O").alias("c1"))
    return counted.select(unpack("code", PROBE_LENGTH).alias("seq"), "c0", "c1")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, features, y``: embeddings as doubles; labels below 5 are 1, others -1."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pentamer, feature, value`` for all 1024 pentamers, two features."""
    codes = spark.range(1024)
    values = codes.select(unpack("id", 5).alias("pentamer"), (F.col("id") * 31 % 97 / 97.0).alias("f0"), (F.col("id") * 17 % 89 / 89.0).alias("f1"))
    return values.unpivot("pentamer", ["f0", "f1"], "feature", "value")


def _unpacked(code: str, k: int) -> str:
    return f"array_to_string(list_transform(range({k - 1}, -1, -1), lambda i: substr('ACGT', 1 + (({code} // (4**i)::BIGINT) % 4)::INT, 1)), '')"


_LEFT = "CASE l_returnflag WHEN 'A' THEN 'TGG' WHEN 'N' THEN 'CCA' ELSE 'GAT' END"

#: The same tables as SQL, by name; ``with_tables`` puts those that a query names before it.
SQL = {
    "contigs": "SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents",
    "genome": "SELECT doc_id AS chrom, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq FROM documents",
    "words8": f"SELECT *, {CODE} AS code, {_unpacked('(' + CODE + ')', 8)} AS word FROM lineitem",
    "reads": f"""SELECT l_orderkey * 10 + l_linenumber AS read_id, 'run' || l_linestatus AS run,
        {_LEFT} || CASE WHEN l_orderkey % 17 = 0 THEN 'N' || substr(word, 2) ELSE word END
        || CASE WHEN l_orderkey % 13 = 0 THEN '{WRONG_BARCODE}' ELSE '{RIGHT_BARCODE}' END AS seq FROM words8""",
    "samples": f"""SELECT DISTINCT 'run' || l_linestatus AS run, l_linestatus || l_returnflag AS sample, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS round,
        {PROBE_LENGTH} AS var_len, {_LEFT} AS left_barcode, '{RIGHT_BARCODE}' AS right_barcode,
        CASE WHEN l_linestatus <> 'F' THEN 'runF' END AS round0_run, CASE WHEN l_linestatus <> 'F' THEN 'F' || l_returnflag END AS round0_sample FROM lineitem""",
    "probes": "SELECT code, any_value(word) AS seq, count(*) AS n FROM words8 GROUP BY code",
    "rounds": "SELECT any_value(word) AS seq, count(*) FILTER (l_linestatus = 'F') AS c0, count(*) FILTER (l_linestatus = 'O') AS c1 FROM words8 GROUP BY code",
    "examples": "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS features, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM embeddings",
    "universe": f"SELECT range AS code, {_unpacked('range', 8)} AS seq FROM range(65536)",
    "shape": f"SELECT {_unpacked('c', 5)} AS pentamer, f AS feature, CASE f WHEN 'f0' THEN c * 31 % 97 / 97.0::DOUBLE ELSE c * 17 % 89 / 89.0::DOUBLE END AS value FROM (SELECT range AS c, unnest(['f0', 'f1']) AS f FROM range(1024))",
}


#: Tables that another one reads.
NEEDS = {"reads": ("words8",), "probes": ("words8",), "rounds": ("words8",)}


def with_tables(names: str, rest: str) -> str:
    """A query over named tables: ``rest`` is its SELECT, or further ``name AS (...), ...`` clauses and the SELECT."""
    listed: list[str] = []
    for n in names.split():
        listed += [x for x in (*NEEDS.get(n, ()), n) if x not in listed]
    clauses = ",\n".join(f"{n} AS ({SQL[n]})" for n in listed)
    rest = rest.strip()
    return f"WITH {clauses}\n{rest}" if rest.upper().startswith("SELECT") else f"WITH {clauses},\n{rest}"


def sql_windows(seq: str, k: int) -> str:
    """All words of length k of a text, as a list."""
    return f"list_transform(range(1, length({seq}) - {k} + 2), lambda i: substr({seq}, i, {k}))"


def sql_reverse_complement(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def sql_list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def sql_window_log(word: str, mode: Mode) -> str:
    """Sum of a mode's weights over a word of its length."""
    mono = [f"list_extract({sql_list(mode.mono)}, {4 * p} + strpos('ACGT', substr({word}, {p + 1}, 1))::INT)" for p in range(mode.k)]
    di = [f"list_extract({sql_list(mode.di)}, {16 * p} + (strpos('ACGT', substr({word}, {p + 1}, 1))::INT - 1) * 4 + strpos('ACGT', substr({word}, {p + 2}, 1))::INT)" for p in range(mode.k - 1 if mode.di else 0)]
    return "(" + " + ".join(mono + di) + ")"


def sql_window_score(word: str, mode: Mode) -> str:
    """Both strands' scores of a word, summed."""
    return f"(exp({sql_window_log(word, mode)}) + exp({sql_window_log(sql_reverse_complement(word), mode)}))"


def sql_probe_score(seq: str, *modes: Mode, nonspecific: float | None = None) -> str:
    parts = [f"list_sum(list_transform({sql_windows(seq, m.k)}, lambda w: {sql_window_score('w', m)}))" for m in modes]
    return "(" + " + ".join(parts + ([f"exp({nonspecific!r}::DOUBLE)"] if nonspecific is not None else [])) + ")"
