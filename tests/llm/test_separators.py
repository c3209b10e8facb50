"""Separator scan: an exact round trip."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm.separators import END_ID, count_tokens, op10_separator_scan, read_flat_files, scan, write_flat_files
from marlstone.llm.tokens import default_vocabulary


def test_query_on_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows}
    assert {r.doc_id: r.n_tokens for r in op10_separator_scan(spark, small).collect()} == want


def test_blocks_of_any_size(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(9001, None, 1), (9002, "", 2), (None, "a", 3), (9003, "long " * 20_000, 4), (9003, "b", 5)], "doc_id long, text string, block int")
    docs = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).coalesce(1)
    columns = ["ordinal", "start", "n_tokens", "closed", "doc_id"]
    read = lambda size: sorted((tuple(r) for r in count_tokens(docs, block_tokens=size).select(*columns).collect()), key=str)
    assert read(1 << 18) == read(1000) == read(7)
    assert len(read(1000)) == docs.count()
    # a new file after every 5,000 tokens: other places, the same counts
    cut = count_tokens(docs, file_tokens=5000).collect()
    assert len({r.stream for r in cut}) > 3
    assert sorted((r.n_tokens, r.doc_id) for r in cut if r.doc_id) == sorted((n, d) for _, _, n, _, d in read(1000) if d)


def test_columns_of_any_name_play_no_part(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, stream string, ordinal string, block int")
    assert [(r.doc_id, r.n_tokens) for r in count_tokens(docs).collect()] == [(1, 3)]


def test_the_prefix_scan_passes_chunks(spark, tmp_path):
    """One file of more blocks than a chunk has, cut at odd places, with documents that run over whole chunks."""
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 100, 40_001).astype("<u2")
    ids[[5, 6, 900, 21_000, 21_001, 35_000]] = END_ID
    (tmp_path / "one.bin").write_bytes(ids.tobytes())
    stops = [*(np.flatnonzero(ids == END_ID) + 1).tolist(), len(ids)]
    want = [(n, s, e - s) for n, (s, e) in enumerate(zip([0, *stops], stops, strict=False))]
    for size in (3, 7, 333):
        found = scan(read_flat_files(spark, str(tmp_path), block_tokens=size))
        assert [(r.ordinal, r.start, r.n_tokens) for r in found.orderBy("ordinal").collect()] == want


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    want = {}
    for name in ("a", "b", "empty"):
        ids = rng.integers(0, 100, 0 if name == "empty" else 5000).astype("<u2")
        ids[rng.random(len(ids)) < 0.01] = END_ID
        if name == "b":
            ids[-1] = 5  # ends open
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == END_ID) + 1
        stops = [*ends.tolist(), *([len(ids)] if len(ids) and (not len(ends) or ends[-1] < len(ids)) else [])]
        want[name] = [(s, e - s) for s, e in zip([0, *stops], stops, strict=False)]
    got = {name: [] for name in want}
    for r in scan(read_flat_files(spark, str(tmp_path), block_tokens=333)).orderBy("stream", "ordinal").collect():
        got[r.stream.rsplit("/", 1)[1].removesuffix(".bin")].append((r.start, r.n_tokens))
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs).count() == 0


def test_a_task_that_runs_again_leaves_one_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    for _ in range(2):
        names = write_flat_files(docs, str(tmp_path / "flat"))
    assert [f.name for f in (tmp_path / "flat").iterdir()] == ["part-00000-00000"] and names.count() == 50


def test_blocks_of_a_large_file_are_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(12)
    ids = rng.integers(0, 100, 4_000_003).astype("<u2")
    ids[rng.random(len(ids)) < 0.0001] = END_ID
    (tmp_path / "with space.bin").write_bytes(ids.tobytes())
    blocks = read_flat_files(spark, str(tmp_path), block_tokens=1 << 16, task_bytes=1 << 20)
    tasks = blocks.select(F.spark_partition_id().alias("task"), F.length("payload").alias("n")).groupBy("task").agg(F.count("n").alias("blocks"), F.max("n").alias("most")).collect()
    assert len(tasks) == 8 and sum(t.blocks for t in tasks) == 62 and max(t.blocks for t in tasks) <= 16
    assert max(t.most for t in tasks) == 2 << 16
    stops = [*(np.flatnonzero(ids == END_ID) + 1).tolist(), len(ids)]
    want = [(s, e - s) for s, e in zip([0, *stops], stops, strict=False) if e > s]
    assert [(r.start, r.n_tokens) for r in scan(blocks).orderBy("ordinal").collect()] == want
