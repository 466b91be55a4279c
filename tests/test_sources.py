from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators.affinity import genome_scan
from tessera.operators.counts import count_kmers
from tessera.plans import catalog
from tessera.plans import fixtures as X
from tessera.sources import readers, writers

READS = ["TGGACGTACGTCCAGCTG", "tggacgtacgtCCAGCTG", "TGGACGNACGTCCAGCTG", "TG", "TGGACGTACGTAAAAAAA"] * 4


@pytest.fixture
def fastq(tmp_path):
    lines = [x for i, s in enumerate(READS) for x in (f"@r{i}", s, "+", "@" + "I" * (len(s) - 1))]
    (tmp_path / "r.fastq").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "r.fastq")


def test_fastq_keeps_sequence_lines_in_order(spark, fastq):
    rows = readers.read_fastq(spark, fastq, "x").orderBy("read_id").collect()
    assert [r.seq for r in rows] == READS
    assert {r.run for r in rows} == {"x"}


def test_fasta_chunks_give_every_window_once(spark, tmp_path):
    seq = "ACGTNNACGTTTGACCA" * 20
    body = "\n".join(seq[i : i + 50] for i in range(0, len(seq), 50))
    (tmp_path / "a.fa").write_text(f">chr1 test\n{body}\n")
    clean = seq.replace("N", "")
    pieces = readers.read_fasta(spark, str(tmp_path / "a.fa"), k=5, chunk=37)
    got = {r.kmer: r.n for r in count_kmers(pieces, 5).collect()}
    want: dict[str, int] = {}
    for i in range(len(clean) - 4):
        want[clean[i : i + 5]] = want.get(clean[i : i + 5], 0) + 1
    assert got == want
    kept = readers.read_fasta(spark, str(tmp_path / "a.fa"), k=5, keep_case=True).collect()
    assert kept[0].seq == seq and kept[0].chrom == "chr1"


def test_fasta_with_many_contigs(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">c1 first\nACGT\nAC\n>c2 GATTACA\nTTTT\n")
    (tmp_path / "n.fa").write_text(">c3\r\nGG\r\nNC\r\n")
    rows = {r.chrom: r.seq for r in readers.read_fasta(spark, str(tmp_path / "*.fa"), k=2).collect()}
    assert rows == {"c1": "ACGTAC", "c2": "TTTT", "c3": "GGC"}


def plain_windows(text: str, k: int, keep_case: bool) -> dict:
    """Every contig's windows by name and place."""
    out, name, seqs = {}, None, {}
    for line in text.splitlines():
        if line.startswith(">"):
            name = line[1:].split()[0]
            seqs[name] = ""
        elif name is not None:
            seqs[name] += "".join(line.split()) if keep_case else "".join(b for b in line.upper() if b in "ACGT")
    for name, seq in seqs.items():
        out |= {(name, i): seq[i : i + k] for i in range(len(seq) - k + 1)}
    return out


@pytest.mark.parametrize("keep_case", [False, True])
@pytest.mark.parametrize(("k", "chunk", "width"), [(6, 100, 50), (1, 64, 50), (25, 7, 11), (40, 1000, 9)])
def test_one_contig_in_many_splits(spark, tmp_path, k, chunk, width, keep_case):
    """Splits of a few lines: contigs that span many, end at a split's end, are empty or shorter than a window."""
    import random

    rng = random.Random(k)

    def lines(n):
        seq = "".join(rng.choice("ACGTacgtNn") for _ in range(n))
        return "".join(seq[i : i + width] + "\n" for i in range(0, n, width))

    text = "ACGTACGT\n" + "".join(f">c{i} more words\n{lines(n)}" for i, n in enumerate((9000, 0, 3, 700, 1, 0, 2500, 12, 30)))
    (tmp_path / "one.fa").write_text(text)
    (tmp_path / "two.fa").write_text(">only\n" + lines(1500))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "256")
    try:
        pieces = readers.read_fasta(spark, str(tmp_path), k, chunk, keep_case)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = pieces.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = plain_windows(text, k, keep_case) | plain_windows((tmp_path / "two.fa").read_text(), k, keep_case)
    found = [((r.chrom, r.pos_start + i), r.seq[i : i + k]) for r in rows for i in range(len(r.seq) - k + 1)]
    assert len(found) == len(want) and dict(found) == want
    assert max(len(r.seq) for r in rows) <= chunk + k - 1 + max(chunk, width + k)
    assert {r.chrom for r in rows} == {"only", *(f"c{i}" for i in range(9))}
    assert all(len([r for r in rows if r.chrom == c]) == 1 for c in ("c1", "c5"))


def test_fastq_in_many_splits_and_files(spark, tmp_path):
    import gzip

    words = ["ACGT"[i % 4] * (1 + i % 7) for i in range(3000)]
    for f in range(3):
        text = "".join(f"@r{i}\n{w}\n+\n{'@' * len(w)}\n" for i, w in enumerate(words[f * 1000 : f * 1000 + 1000]))
        path = tmp_path / f"p{f}.fastq"
        if f == 2:
            with gzip.open(f"{path}.gz", "wt") as out:
                out.write(text)
        else:
            path.write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == words and [r.read_id for r in rows] == list(range(3000))


def test_written_fasta_has_lines_of_fifty(spark, tmp_path):
    df = spark.createDataFrame([("c", "A" * 100), ("d", "C" * 51)], "chrom string, seq string")
    writers.write_fasta(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert sorted(len(x) for x in text.split("\n") if x and x[0] != ">") == [1, 50, 50, 50]


def test_ragged_csv_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,y\n1,2,1\n1,2\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_labelled_csv(spark, str(tmp_path / "x.csv")).collect()


def test_round_counts_layouts_differ_by_parameter(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("ACGT\t5\t0\nGGGG\t0\t7\n")
    rows = readers.observed_in(readers.read_round_counts(spark, str(tmp_path / "r.tsv"), 2), 1).collect()
    assert [(r.seq, r.n) for r in rows] == [("GGGG", 7)]


@pytest.mark.parametrize("pieces", [1, 2, 128])
def test_chunks_of_long_contigs_are_cut_in_parts_first(spark, monkeypatch, pieces):
    monkeypatch.setattr(readers, "PIECES", pieces)
    texts = ["", "AC", "ACG", "ACGTNé" * 9, "acgtn" * 4]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chrom int, seq string")
    found = sorted((r.chrom, r.pos_start, r.seq) for r in readers.chunked(df, "seq", 3, 5).collect())
    assert found == [(i, at, t[at : at + 7]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - 2), 5)]


def test_dealt_tracks_are_sorted_whole_and_split_one_place(spark, tmp_path):
    """400 contigs of one place are more than a task's share, so several files hold them; each is sorted, and no score is lost."""
    df = spark.createDataFrame([(i % 2, i, "ACGTNacgt" * (1 + i % 3)) for i in range(400)], "chrom long, contig long, seq string")
    cut = readers.chunked(df, "seq", 3, 256)
    writers.write_track(genome_scan(writers.dealt_by_place(cut, "contig"), X.NARROW), f"{tmp_path}/track", dealt=True)
    rows = spark.read.parquet(f"{tmp_path}/track").select("chrom", "pos", "forward", "reverse", "flag", F.input_file_name().alias("file")).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r) for r in genome_scan(cut, X.NARROW).collect())
    assert len({r.file for r in rows if r.chrom == 0 and r.pos == 0}) > 1
    for file in {r.file for r in rows}:
        own = [r.pos for r in spark.read.parquet(file).collect()]
        assert own == sorted(own)


def shuffled_rows(spark, after: int = -1) -> tuple[int, int]:
    """Rows that stages after a number wrote for shuffles, and the last stage's number."""
    context, none = spark.sparkContext, spark._jvm.java.util.ArrayList()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(spark._jvm.double, 0), none)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_track_query_shuffles_no_row_a_window(spark, sf_dir):
    _, last = shuffled_rows(spark)
    windows = sum(r.windows for r in catalog.QUERIES["a9_score_track"](spark, sf_dir).collect())
    assert windows > 100_000 and 0 < shuffled_rows(spark, last)[0] < windows / 10
