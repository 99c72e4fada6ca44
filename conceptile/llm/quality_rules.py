"""Quality rules as a learned decision list, in built-in expressions only.

Documents are measured once. Sequential covering then learns, from the counts of good and bad labels by measure and threshold,
an ordered list of conjunctions that reject: each is grown one condition at a time by information gain on two thirds of the
labelled rows, for as long as there is one, cut back to the prefix that does best on the other third of those that cover ``LEAST_COVER`` bad rows
and ``LEAST_SHARE`` of all bad ones there, and kept only if ``LEAST_PRECISION`` of what it covers there is bad; what it covers is taken away before the
next. The first rule that fails this ends the list: neither rules nor conditions are counted. Thresholds lie at the ``CUTS``
quantiles (approximate ones, to a thousandth) of each measure among the good and among the bad. Every statistic is a grouped count
over all labelled rows; the driver sees one row for each measure and threshold. The list becomes one conditional expression.

Defined cases: a null or empty text has no words, fails the base rule and is rejected; labels that are null or for unknown
documents are left out, and a document labelled both ways counts as good; without bad labels the list is empty and only the
base rule rejects; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import once
from .common import Scratch, sieve, table

SPACE, CUTS, LEAST_PRECISION, LEAST_COVER, LEAST_SHARE = r"[\x20\x09-\x0D]+", 16, 0.9, 5, 0.001
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "words_per_line"]


def measured(docs: DataFrame) -> DataFrame:
    """The input's columns with ``_m``, a struct of the counts of the contract and of MEASURES (doubles; 0 without words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({"_w": once(F.filter(F.split(text, SPACE), lambda x: x != "")), "_l": once(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))})
    w, n = F.col("_w"), F.size("_w")
    window = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p"))
    df = df.withColumn("_s", once(F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))))
    s = F.col("_s")
    twice = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"]))
    df = df.withColumn("_p", once(F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    raw = F.struct(
        long(n).alias("n_words"), long(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).alias("n_symbols"), long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"), long(F.size("_l")).alias("n_lines"), long(F.size(F.array_distinct("_w"))).alias("n_distinct"),
    )
    df = df.withColumn("_r", once(raw)).drop("_w", "_l", "_s", "_p")
    share = lambda a, b: (F.col(f"_r.{a}") / F.greatest(F.col(f"_r.{b}"), F.lit(1))).cast("double")
    rates = {"chars_per_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"), "words_per_line": share("n_words", "n_lines")}
    return df.withColumn("_m", F.struct(*[F.col(f"_r.{c}").alias(c) for c in COUNTS], *[c.alias(k) for k, c in rates.items()])).drop("_r")


@dataclass(frozen=True)
class Condition:
    measure: str
    least: bool  # at least the threshold, else below it
    threshold: float

    def column(self, measure) -> Column:
        c = measure(self.measure).cast("double")
        return c >= F.lit(self.threshold) if self.least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.least else '<'} {self.threshold:g}"


Rule = list[Condition]


def verdict(rules: list[Rule], measure=lambda m: F.col(f"_m.{m}")) -> Column:
    """The ordered list as one conditional expression: the number, from 1, of the first rule that rejects; 0 keeps."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column(measure)
        for c in rule[1:]:
            holds = holds & c.column(measure)
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_list(labelled: DataFrame) -> list[Rule]:
    """Rules for ``bad`` rows of a frame of (bad boolean, fold int, a double for each of MEASURES): fold 0 prunes, others grow."""
    cuts = labelled.groupBy("bad").agg(*[F.percentile_approx(m, [(i + 0.5) / CUTS for i in range(CUTS)], 1000).alias(m) for m in MEASURES]).collect()
    if {r.bad for r in cuts} != {True, False}:
        return []
    scratch = Scratch(labelled.sparkSession)
    at = {m: sorted({x for r in cuts for x in r[m]}) for m in MEASURES}
    place = {m: {t: k for k, t in enumerate(at[m])} for m in MEASURES}
    # a row's bin in a measure: how many thresholds it reaches; found once, rules are then conditions on whole numbers
    reached = lambda m: F.size(F.filter(F.array(*map(F.lit, at[m])), lambda t: t <= F.col(m))).alias(m)
    binned = scratch.keep(labelled.select("bad", (F.col("fold") == 0).alias("prune"), *map(reached, MEASURES)).groupBy("bad", "prune", *MEASURES).count(), "bins")
    bins = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("bin")) for m in MEASURES])

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            reaches = F.col(c.measure) > place[c.measure][c.threshold]
            out = out & (reaches if c.least else ~reaches)
        return out

    def statistics(left: DataFrame) -> tuple[dict, list]:
        got = left.select("bad", "prune", "count", F.explode(bins).alias("x")).groupBy("prune", "x.m", "x.bin", "bad").agg(F.sum("count").alias("n")).collect()
        counts: dict = {(m, p, b): [0] * (len(at[m]) + 1) for m in MEASURES for p in (False, True) for b in (False, True)}
        for r in got:
            counts[r.m, r.prune, r.bad][r.bin] = r.n
        return counts, [sum(counts[MEASURES[0], False, bad]) for bad in (True, False)]

    rules: list[Rule] = []
    least_cover = max(LEAST_COVER, LEAST_SHARE * (binned.where("prune and bad").agg(F.sum("count")).first()[0] or 0))
    rest = binned
    while True:
        rule: Rule = []
        pruned: list[tuple[int, int]] = []
        counts, (p0, n0) = statistics(rest)
        while p0 and n0:
            best = None
            for m in MEASURES:
                # how many rows are below each threshold, of either kind, in both parts
                below = {k: list(accumulate(counts[m, *k])) for k in ((False, True), (False, False), (True, True), (True, False))}
                for k, t in enumerate(at[m]):
                    for least in (True, False):
                        took = {kind: n[-1] - n[k] if least else n[k] for kind, n in below.items()}
                        p, n = took[False, True], took[False, False]
                        if p >= LEAST_COVER:
                            gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, Condition(m, least, t), (took[True, True], took[True, False]))
            if best is None:
                break
            rule.append(best[1])
            pruned.append(best[2])
            counts, (p0, n0) = statistics(rest.where(holds(rule)))
        value = [(p - n) / (p + n) if p >= least_cover else -1.0 for p, n in pruned]
        if not value or max(value) < 2 * LEAST_PRECISION - 1:
            break
        length = value.index(max(value)) + 1
        rules.append(rule[:length])
        rest = rest.where(~holds(rules[-1]))
    scratch.drop(binned)
    return rules


def labelled_rows(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each labelled document of ``measures`` (doc_id, _m)."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    one = measures.where("doc_id is not null").join(known, "doc_id")
    return one.select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"), *[F.col(f"_m.{m}").cast("double").alias(m) for m in MEASURES])


def base_failed() -> Column:
    return (F.col("_m.n_words") < 50) | (F.col("_m.n_repeat_words") * 100 > F.col("_m.n_words") * 50)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rule (the number of the learned rule that rejects, else 0)."""
    scratch = Scratch(docs.sparkSession)
    measures = scratch.keep(measured(docs.select("doc_id", "text")).drop("text"), "measures")
    labelled = scratch.keep(labelled_rows(measures, labels), "labelled")
    rules = learn_list(labelled)
    scratch.drop(labelled)
    rule = verdict(rules)
    return measures.select("doc_id", *[f"_m.{c}" for c in COUNTS], base_failed().alias("base_failed"), (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that base rule and learned list keep, in their own columns. Only those with labels are measured to learn the list;
    all are measured when it is applied, so that no copy of the documents is written."""
    scratch, labels = Scratch(spark), table(spark, sf_dir, "labels")
    has_label = sieve(labels.where("quality is not null"), "doc_id")
    named = docs.select("doc_id", "text").where(has_label(F.col("doc_id")))  # and few others, which labels are not joined with
    labelled = scratch.keep(labelled_rows(measured(named).drop("text"), labels), "labelled")
    rules = learn_list(labelled)
    scratch.drop(labelled)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")  # whatever the columns are called
    return measured(whole).where(~base_failed() & (verdict(rules) == 0)).select("_doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
