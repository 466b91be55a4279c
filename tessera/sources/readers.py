"""Sources: reads, contigs, count tables, labelled matrices, word lists, shape tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_fastq(spark: SparkSession, path: str, run: str = "run", partitions: int | None = None) -> DataFrame:
    """``run, read_id, seq``: the second line of each record of four lines, plain or gzip; every file holds whole records.

    Only a line's number tells a sequence from a quality line. Lines are numbered where they are
    scanned, and one small row for each split of a file says where its numbers start, so lines
    themselves aren't shuffled. ``read_id`` counts records by file name, then place. Gzip files
    are one split each, so give ``partitions`` to spread what follows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = lines.join(offsets, ["_file", "_start"]).withColumn("_line", F.col("_at") + F.col("_shift"))
    reads = numbered.where("_line % 4 = 1").select(F.lit(run).alias("run"), F.floor(F.col("_line") / 4).alias("read_id"), F.col("value").alias("seq"))
    return reads.repartition(partitions) if partitions else reads


def read_fasta(spark: SparkSession, path: str, k: int, chunk: int = 1_000_000, keep_case: bool = False) -> DataFrame:
    """``chrom, pos_start, seq``: every contig of the files, in pieces whose windows of ``k`` bases are each window of it once.

    A line that starts with ``>`` is a contig's header and its first word the name; lines before
    the first header belong to none. Files are scanned line by line and cut wherever their splits
    end, so one chromosome is many tasks: a piece holds the window starts of up to ``chunk``
    bases, ends where its split does, and takes its last ``k - 1`` bases from the splits behind
    it. One small row a split says which contig it begins in, at which base, and what follows.
    Without ``keep_case`` letters other than ACGT are skipped after upper-casing, as for
    counting; with it the sequence stays as it is, N and lower case included, as for scanning.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    found = lines.mapInPandas(_scanner(k, chunk, keep_case), "_file string, _start long, segment int, name string, at long, seq string, open boolean, summary boolean")
    pieces, splits = found.where("not summary").drop("summary"), found.where("summary")
    begins = splits.groupBy("_file").applyInPandas(_resolver(k), "_file string, _start long, before string, offset long, halo string, follows boolean")  # one row a split
    joined = pieces.join(begins, ["_file", "_start"])
    first = F.col("segment") == 0
    seq = F.concat("seq", F.when(F.col("open"), F.col("halo")).otherwise(""))
    made = joined.select(
        F.when(first, F.col("before")).otherwise(F.col("name")).alias("chrom"), (F.col("at") + F.when(first, F.col("offset")).otherwise(0)).alias("pos_start"), seq.alias("seq"),
        ((F.col("seq") == "") & (first | F.col("open") & F.col("follows"))).alias("_elsewhere"),  # an empty end whose contig has its row in another split
    )
    whole = (F.length("seq") >= k) | (F.col("pos_start") == 0)  # a contig shorter than a window is one piece
    return made.where(F.col("chrom").isNotNull() & ~F.col("_elsewhere") & whole).drop("_elsewhere")


def _scanner(k: int, chunk: int, keep_case: bool):
    """Pieces of the lines of each split, in file order, and a last row for the split: its segments (those before its first header are number 0), the
    name of the last one, its bases, and the first ``k - 1`` bases of segment 0 with the number of all of them."""
    other = {i: None for i in range(128) if chr(i) not in "ACGT"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, rows = None, []

        def opened(file: str, start: int) -> dict:
            return {"file": file, "start": start, "segment": 0, "name": None, "at": 0, "held": [], "size": 0, "lead": "", "first": 0}

        def piece(s: dict, is_open: bool) -> None:
            text = "".join(s["held"])
            while len(text) >= chunk + k - 1 and len(text) > chunk:
                rows.append((s["file"], s["start"], s["segment"], s["name"], s["at"], text[: chunk + k - 1], False, False))
                text, s["at"] = text[chunk:], s["at"] + chunk
            s["held"], s["size"] = [text], len(text)
            if is_open is not None:
                if s["segment"] == 0:
                    s["first"] = s["at"] + len(text)
                rows.append((s["file"], s["start"], s["segment"], s["name"], s["at"], text, is_open, False))

        def closed(s: dict) -> None:
            piece(s, True)
            bases = s["at"] + s["size"]
            rows.append((s["file"], s["start"], s["segment"], s["name"], bases, f"{s['first']}:{s['lead']}", False, True))

        def taken() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["_file", "_start", "segment", "name", "at", "seq", "open", "summary"])
            rows.clear()
            return out

        for frame in frames:
            for value, file, start in zip(frame["value"], frame["_file"], frame["_start"], strict=True):
                if split is None or (split["file"], split["start"]) != (file, start):
                    if split is not None:
                        closed(split)
                    split = opened(file, start)
                if value.startswith(">"):
                    piece(split, False)
                    split |= {"segment": split["segment"] + 1, "name": (value[1:].split() or [""])[0], "at": 0, "held": [], "size": 0}
                    continue
                bases = "".join(value.split()) if keep_case else value.upper().translate(other)
                if not keep_case and not bases.isascii():
                    bases = "".join(b for b in bases if b in "ACGT")
                if split["segment"] == 0 and len(split["lead"]) < k - 1:
                    split["lead"] = (split["lead"] + bases)[: k - 1]
                split["held"].append(bases)
                split["size"] += len(bases)
                if split["size"] >= 2 * chunk + k:
                    piece(split, None)
            yield taken()
        if split is not None:
            closed(split)
            yield taken()

    return run


def _resolver(k: int):
    """What each split of a file begins in: the contig's name, the bases of it before the split, the ``k - 1`` bases behind the split, whether any follow."""

    def run(splits: pd.DataFrame) -> pd.DataFrame:
        rows = splits.sort_values("_start").to_dict("records")
        name, offset = None, 0
        for r in rows:
            first, lead = r["seq"].split(":", 1)
            r |= {"before": name, "offset": offset, "first": int(first), "lead": lead}
            name, offset = (r["name"], r["at"]) if r["segment"] else (name, offset + r["first"])
        halo, follows = "", False
        for r in reversed(rows):
            r["halo"], r["follows"] = halo, follows
            own = r["first"] > 0
            halo, follows = (r["lead"], own) if r["segment"] else ((r["lead"] + halo)[: k - 1], own or follows)
        return pd.DataFrame(rows)[["_file", "_start", "before", "offset", "halo", "follows"]]

    return run


def skip_invalid(seq):
    """Upper case without anything but ACGT: invalid letters are skipped and do not break windows."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "")


#: Pieces that are cut from one part of a contig: places in a text are found from its start, so long contigs are cut in parts first.
PIECES = 128


def chunked(contigs: DataFrame, seq: str, k: int, chunk: int) -> DataFrame:
    """Rows of ``contigs`` with ``seq`` cut into pieces of ``chunk`` window starts and their ``pos_start``."""

    def cut(rows: DataFrame, size: int, start: str) -> DataFrame:
        starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - k, F.lit(0)), F.lit(size))
        return rows.withColumn(start, F.explode(starts)).withColumn(seq, F.substr(seq, F.col(start) + 1, F.lit(size + k - 1)))

    pieces = cut(cut(contigs, chunk * PIECES, "_part"), chunk, "pos_start")
    return pieces.withColumn("pos_start", F.col("_part") + F.col("pos_start")).drop("_part")


def read_round_counts(spark: SparkSession, path: str, rounds: int, first_count: int = 1) -> DataFrame:
    """``seq, c0, c1, ...`` from tab-separated rows without header whose counts start at column ``first_count``."""
    names = ["seq"] + [f"skip{i}" for i in range(1, first_count)] + [f"c{r}" for r in range(rounds)]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "seq" or n.startswith("skip") else T.LongType()) for n in names])
    return spark.read.csv(path, sep="\t", schema=schema).select("seq", *[f"c{r}" for r in range(rounds)])


def observed_in(counts: DataFrame, round_number: int) -> DataFrame:
    """``seq, n`` of the rows that one round has seen."""
    return counts.where(F.col(f"c{round_number}") > 0).select("seq", F.col(f"c{round_number}").alias("n"))


def read_counts(spark: SparkSession, path: str, sample: str | None = None, k: int | None = None) -> DataFrame:
    """A count table; sample and k prune partitions."""
    counts = spark.read.parquet(path)
    counts = counts if sample is None else counts.where(F.col("sample") == sample)
    return counts if k is None else counts.where(F.col("k") == k)


def read_labelled_csv(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``features, y`` from a CSV with header whose last column is the class; ragged rows fail.

    ``first`` keeps that many rows in the order of their feature values, which unlike the order
    of lines does not depend on how files are split.
    """
    columns = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    made = rows.select(F.array(*columns[:-1]).alias("features"), F.col(columns[-1]).alias("y"))
    return made if first is None else made.orderBy("features", "y").limit(first)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``seq``: one word per line, upper case, lines with other letters left out."""
    lines = spark.read.text(path).select(F.upper(F.trim("value")).alias("seq"))
    return lines.where(F.col("seq").rlike("^[ACGT]+$"))


def read_shape_table(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """``pentamer, feature, value`` from a CSV of quoted pentamers whose values stand in columns 1, 3, 5 and so on."""
    names = ["pentamer"] + [x for f in features for x in (f, f"skip_{f}")]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "pentamer" or n.startswith("skip_") else T.DoubleType()) for n in names])
    rows = spark.read.csv(path, schema=schema)
    return rows.unpivot("pentamer", list(features), "feature", "value")
