from __future__ import annotations

from tessera.operators.counts import count_kmers
from tessera.plans import fixtures as X
from tessera.streaming.word_counts import latest_counts, read_stream, running_counts, write_counts_stream


def test_stream_ends_at_the_batch_counts(spark, sf_dir, tmp_path):
    reads = X.reads(spark, sf_dir).select("run", "read_id", "seq").where("seq NOT LIKE '%N%'")
    reads.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    write_counts_stream(running_counts(stream, 4), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.run, r.kmer): r.n for r in latest_counts(spark, str(tmp_path / "out")).collect()}
    want = {(r.run, r.kmer): r.n for r in count_kmers(reads, 4, by=("run",)).collect()}
    assert got == want
