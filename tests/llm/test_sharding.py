import zlib
from collections import defaultdict

from conceptile.llm.sharding import assign_shards, op1_jump_sharding


def jump(key, n):
    """The published algorithm, on Python's integers."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def check(rows, got, n=24):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id or 0, n), jump(r.doc_id or 0, n + 1), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want


def test_whole_table_against_the_published_walk(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op1_jump_sharding(spark, sf_dir).collect())


def test_nulls_repeats_long_texts_and_clashing_names(spark, docs, table_dir):
    rows = [(None, "x"), (1, None), (2, ""), (2, ""), (2, "é" * 50_000), (-5, "a"), (2**62, "b"), *[(7, "same")] * 40]
    d = table_dir(documents=docs(rows, ["shard", "size", "slot", "grown_shard", "_at"]))
    check(rows, op1_jump_sharding(spark, d).collect())


def test_empty(spark, docs, table_dir):
    assert op1_jump_sharding(spark, table_dir(documents=docs([]))).collect() == []


def test_many_shards_and_few_moves(spark):
    df = spark.range(2000)
    for n in (1, 2, 40, 1000):
        got = assign_shards(df, "id", n).collect()
        assert all((r.shard, r.grown_shard) == (jump(r.id, n), jump(r.id, n + 1)) for r in got)
        assert all(r.shard == r.grown_shard or r.grown_shard == n for r in got)
