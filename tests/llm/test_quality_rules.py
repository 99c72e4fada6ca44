import re
from collections import Counter

from conceptile.llm.quality_rules import MEASURES, judged, labelled_rows, learn_list, measured, op7_quality_rules, quality_stage
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_quality_rules(spark, sf_dir).collect()
    assert {r.doc_id: counts(r) for r in got} == {k: brute(t) for k, t in texts.items()}
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in got)


def test_learned_list_follows_the_labels(spark, sf_dir):
    got = {r.doc_id: r for r in op7_quality_rules(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()
    bad = [got[x.doc_id] for x in labels if x.quality == 0]
    good = [got[x.doc_id] for x in labels if x.quality == 1 and not got[x.doc_id].base_failed]
    assert sum(not r.kept for r in bad) > 0.8 * len(bad)
    assert sum(r.kept for r in good) > 0.97 * len(good)


def test_covering_finds_planted_conjunctions(spark):
    rows = spark.range(3000).select(((F.col("id") % 10 == 0) | (F.col("id") % 17 == 3)).alias("bad"), (F.col("id") % 3).cast("int").alias("fold"), *[F.lit(1.0).alias(m) for m in MEASURES if m not in ("n_words", "symbols_per_word")], F.when(F.col("id") % 10 == 0, 5.0).otherwise(100.0).alias("n_words"), F.when(F.col("id") % 17 == 3, 0.9).otherwise(0.1).alias("symbols_per_word"))
    rules = learn_list(rows.cache())
    assert sorted(str(r[0]).split()[0] for r in rules) == ["n_words", "symbols_per_word"]


def test_defined_cases(spark, docs, table_dir):
    rows = [(1, None), (2, ""), (3, "a b c " * 30), (3, "a b c " * 30), (None, " x\x0by\n\n#\n#"), (5, "Wörter & mehr " * 20_000), (6, " ".join(f"w{i}" for i in range(60)))]
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 0, None), (99, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    frame = docs(rows, ["n_words", "_m", "_w", "kept"])
    got = judged(frame, labels).collect()
    assert sorted((r.doc_id or 0, *counts(r), r.kept) for r in got) == sorted((i or 0, *(b := brute(t)), not b[-1]) for i, t in rows)
    d = table_dir(documents=frame, labels=labels)
    left = quality_stage(spark, frame, d)
    assert left.columns == frame.columns and [r.doc_id for r in left.collect()] == [6]
    empty = docs([])
    assert judged(empty, labels.limit(0)).collect() == [] and labelled_rows(measured(empty), labels).collect() == []
