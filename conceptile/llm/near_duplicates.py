"""Near-duplicate groups by SetSketch registers, verified on whole sets.

1. Each text becomes its set of 5-word shingle hashes. Texts with equal words are one class; only classes go on.
2. A class has REGISTERS registers. Each shingle starts a Poisson process whose points fall on registers at random, so that a
   register's least point is exponential with the size of the set as its rate; what is kept is its exponent to base 1.001,
   truncated to 16 bits. Sketches of unions are maxima of registers, and two registers agree with about the probability of the
   Jaccard similarity. Only the few points below a bound are drawn; a set that leaves a register empty is drawn again with a
   higher bound, so that the registers do not depend on it.
3. Bands of ROWS registers are hashed (5 miss a pair at 85 % with 4e-7, at 80 % with 5e-5; 4 with 5e-8 there). In a bucket of a few members all are paired; in a larger one, every member with the least
   one (the hub) and with the least of a few random hands: a linear number of pairs, however large the bucket.
4. For each pair the similarity is estimated jointly from the registers that are larger, smaller and equal and from both sizes,
   by maximum likelihood; pairs more than six standard deviations below the threshold are let go.
5. What is left is verified on the whole sets; links make components by alternating large and small stars.
6. A large bucket whose members are now in several components has pairs that no hub has tested. They are tested as in 4 and 5,
   in chunks of bounded size against one another, and only links are returned (pairs within one component change nothing): no
   pair is listed, and no link that shares a bucket is lost. The bucket's largest component is not compared with itself, so that
   its members are copied once for each CHUNK members of the others. The work for texts that look alike but are no
   near-duplicates grows with the square of their number (a pair is 128 comparisons of small integers); nothing else does.

Copies are never expanded into pairs. Everything between the steps is written to the shared folder.

Defined cases: a text that is null or has no words has no shingles, is linked with nothing and kept; with fewer than five words
the whole sequence is the one shingle; rows that repeat a doc_id are one document each, with the same words in the same class;
a null doc_id takes part, but never names a component (a component without other ids has a null one, and is kept); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, LONG, Scratch, batches_of, column, mixed, odd_constants, schema, shingle_hashes, sieve, signed, table, word_hashes, words

REGISTERS, ROWS, BASE, SCALE, TOP = 128, 5, 1.001, 20.0, (1 << 16) - 1
THRESHOLD = 85  # per cent
STAGE_THRESHOLD, STAGE_ROWS = 80, 4  # of the pipeline's stage, which has no contract of its own: pairs of 80 per cent and more
DEVIATIONS = 6
DEALS, HAND, CHUNK, CHUNK_SHINGLES = 3, 8, 1024, 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(tokens: list[bytes]) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(tokens)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers, uint16, a row for each set; all zero for an empty one."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    todo, slack = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64), 8.0
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        bound = (np.log(REGISTERS) + slack) / sizes
        doc, h = np.repeat(np.arange(len(todo)), sizes), np.concatenate([sets[i] for i in todo])
        x, least = np.zeros(len(h)), np.full(len(todo) * REGISTERS, np.inf)
        with np.errstate(over="ignore"):
            while len(h):
                h = h + _STEP
                v = mixed(h)
                x = x - np.log(((v >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
                alive = x <= bound[doc]
                h, x, doc, v = h[alive], x[alive], doc[alive], v[alive]
                np.minimum.at(least, doc * REGISTERS + (v & np.uint64(REGISTERS - 1)).astype(np.int64), x)
        least = least.reshape(len(todo), REGISTERS)
        full = np.isfinite(least).all(axis=1)
        out[todo[full]] = np.clip(np.floor(1 - np.log(least[full] / SCALE) / np.log(BASE)), 0, TOP).astype(np.uint16)
        todo, slack = todo[~full], slack * 2
    return out


_BAND = odd_constants(ROWS + 1, 23)


def band_hashes(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """int64, a row for each sketch, a column for each band of so many registers."""
    n = REGISTERS // rows
    r = registers[:, : n * rows].reshape(-1, n, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        return signed(mixed((r * _BAND[:rows]).sum(axis=2) + np.arange(n, dtype=np.uint64) * _BAND[ROWS]))


_GRID = np.linspace(0, 1, 201)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities that make the numbers of larger, smaller and equal registers likeliest, given the sizes of the sets."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    j = _GRID[None, :] * np.minimum(u / (1 - u), (1 - u) / u)  # no larger similarity is possible
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u - (1 - u) * j), 1e-12, 1), np.clip(p(1 - u - u * j), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    best = (more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)).argmax(axis=1)
    return j[np.arange(len(best)), best]


def class_key(tokens: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(tokens)) if tokens else None


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (of the words; null without), n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            tokens = [words(t) for t in column(batch, "text")]
            sets = [shingles(w) for w in tokens]
            arrays = [pa.array([class_key(w) for w in tokens], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], ["doc_id", "text_hash", "key", "n_shingles", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema(doc_id=LONG, text_hash=LONG, key=BINARY, n_shingles=LONG, sketch=BINARY))


def bands(classes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(cid, band): the hash of each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2048):
            h = band_hashes(np.frombuffer(b"".join(column(batch, "sketch")), dtype=np.uint16).reshape(-1, REGISTERS), rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), h.shape[1])), pa.array(h.ravel())], ["cid", "band"])

    return classes.select("cid", "sketch").mapInArrow(run, schema(cid=LONG, band=LONG))


def lowest(threshold: int, deviations: int = DEVIATIONS) -> float:
    """The least estimate at which a pair may still reach the threshold."""
    t = threshold / 100
    return t - deviations * float(np.sqrt(t * (1 - t) / REGISTERS))


def likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that the sketches do not rule out, with both sizes."""
    floor = lowest(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2048):
            side = lambda n, batch=batch: np.frombuffer(b"".join(column(batch, n)), dtype=np.uint16).reshape(-1, REGISTERS)
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(estimates(side("sa"), side("sb"), na, nb) >= floor))

    one = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sides = pairs.join(one("a"), "a").join(one("b"), "b")
    able = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold  # sizes alone rule the others out
    return sides.where(able).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema(a=LONG, b=LONG, na=LONG, nb=LONG))


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    one = lambda c: sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(one("a"), "a").join(one("b"), "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * threshold).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for the nodes of the edges (a, b): the least id of each connected component, by alternating stars."""
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")  # a hub's rows are split in the joins
        large = scratch.keep(both.join(m.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        scratch.drop(m)
        m = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(m.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.distinct(), "small-star")
        scratch.drop(e, large, m)
        e, before, seen = after, seen, state(after)
        if seen == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, key, doc_id), from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 64):
            tokens = [words(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(w) for w in tokens], pa.binary()), pa.array([signed(shingles(w)) for w in tokens], pa.list_(pa.int64()))], ["key", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").where("text is not null").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = texts.mapInArrow(run, schema(key=BINARY, shingles=T.ArrayType(LONG)))
    return found.join(wanted.select("cid", "key"), "key").select("cid", "shingles").dropDuplicates(["cid"])


def hub_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members (band, cid, hub, n): all of a bucket of up to HAND members, and in larger ones each
    with the hub and with the least members of DEALS random deals into hands of about HAND. Linear in the members of a bucket."""
    few = shared.where(F.col("n") <= HAND)
    all_ = few.select("band", F.col("cid").alias("a")).join(few.select("band", F.col("cid").alias("b")), "band").where("a < b").select("a", "b")
    many = shared.where(F.col("n") > HAND)
    # a power of two of hands: buckets of like sizes deal their members alike, so that most of their pairs are the same ones
    hands = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / HAND))).cast("long")
    hand = lambda d: F.struct(F.lit(d).alias("deal"), F.pmod(F.xxhash64("cid", F.lit(d)), hands).alias("hand"))
    dealt = many.select("band", "cid", F.explode(F.array(*map(hand, range(DEALS)))).alias("d")).select("band", "cid", "d.*")
    firsts = dealt.groupBy("band", "deal", "hand").agg(F.min("cid").alias("hub"))
    both = many.select("hub", "cid").unionByName(dealt.join(firsts, ["band", "deal", "hand"]).select("hub", "cid"))
    return both.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).unionByName(all_).distinct()


def dealt_chunks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, cid, root, n_shingles, chunk, lo, hi) of members (band, cid, root, n_shingles): each row is in the group that compares the
    chunks lo and hi of its bucket. Any two members of different roots meet in one group. The root that has most of a bucket's members
    has chunks of its own, which meet only those of the others: where few are outside of it, the copies grow with the members."""
    roots = members.groupBy("band", "root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("k"))
    most = F.max(F.struct("m", "root", "k"))
    chunks = lambda m, k: F.greatest(F.ceil(m / CHUNK), F.ceil(k / CHUNK_SHINGLES)).cast("int")
    size = roots.groupBy("band").agg(most.alias("x"), F.sum("m").alias("m"), F.sum("k").alias("k"))
    size = size.select("band", F.col("x.root").alias("most"), chunks(F.col("m") - F.col("x.m"), F.col("k") - F.col("x.k")).alias("others"), chunks(F.col("x.m"), F.col("x.k")).alias("own"))
    size = scratch.keep(size.where("others > 0"), "chunks")
    inside, hash_ = F.col("root") == F.col("most"), F.xxhash64("cid")
    chunk = F.when(inside, F.col("others") + F.pmod(hash_, F.col("own"))).otherwise(F.pmod(hash_, F.col("others"))).cast("int")
    cut = members.join(size.hint("merge"), "band").withColumn("chunk", chunk)
    met = F.sequence(F.lit(0), F.col("others") + F.when(inside, 0).otherwise(F.col("own")) - 1)
    both = F.transform(met, lambda k: F.struct(F.least("chunk", k).alias("lo"), F.greatest("chunk", k).alias("hi")))
    return cut.withColumn("p", F.explode(both)).select("band", "cid", "root", "n_shingles", "chunk", "p.lo", "p.hi")


def across(placed: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch, threshold: int, rows: int = ROWS) -> DataFrame:
    """Links (a, b) between members (band, cid, root) of one bucket with different roots.

    A bucket is cut into chunks of at most about CHUNK members and CHUNK_SHINGLES shingles; each two chunks are one group, which
    compares them in place and returns nothing but links. A pair is tested in the first band that it shares, and no longer once
    its components are known to be one. Chunks are dealt while rows are small; sketches and sets follow by class, so that nothing
    large is ever moved by its bucket."""
    several = scratch.keep(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band"), "several")
    light = scratch.keep(placed.join(several.hint("merge"), "band", "left_semi").join(classes.select("cid", "n_shingles"), "cid"), "members")
    dealt = dealt_chunks(light, scratch)
    needed = light.select("cid").distinct()
    own = lambda df: df.join(needed, "cid", "left_semi")
    pairs = dealt.join(own(classes.select("cid", "sketch")).join(own(sets), "cid"), "cid")
    floor, fewest = lowest(threshold), lowest(threshold, DEVIATIONS + 1) * REGISTERS

    def run(key: tuple, group: pa.Table) -> pa.Table:
        band, lo, hi = (k.as_py() for k in key)
        group = group.sort_by("cid")
        cid, root, size, chunk = (group[c].to_numpy() for c in ("cid", "root", "n_shingles", "chunk"))
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        shingles = group["shingles"].combine_chunks()
        values, at = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        j = int(np.flatnonzero(band_hashes(sketch[:1], rows)[0] == band)[0]) if len(cid) else 0
        root, links = root.copy(), []
        for x in range(len(cid)):
            other = (root != root[x]) & (100 * np.minimum(size, size[x]) >= threshold * np.maximum(size, size[x]))
            other &= (chunk != chunk[x]) if lo != hi else True
            other[: x + 1] = False
            ys = np.flatnonzero(other)
            if len(ys) == 0:
                continue
            equal = sketch[ys] == sketch[x]
            new = ~equal[:, : j * rows].reshape(len(ys), j, rows).all(axis=2).any(axis=1) & (equal.sum(axis=1) >= fewest)
            ys = ys[new]
            if len(ys) == 0:
                continue
            mine = np.broadcast_to(sketch[x], (len(ys), REGISTERS))
            likely = estimates(mine, sketch[ys], np.full(len(ys), float(size[x])), size[ys].astype(np.float64)) >= floor
            for y in ys[likely]:
                if root[y] != root[x]:
                    n = len(np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True))
                    if 100 * n >= threshold * (size[x] + size[y] - n):
                        links.append((cid[x], cid[y]))
                        root[root == root[y]] = root[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return pairs.groupBy("band", "lo", "hi").applyInArrow(run, schema(a=LONG, b=LONG))


def decided(docs: DataFrame, threshold: int, band_rows: int) -> DataFrame:
    """doc_id, text_hash, group, n_shingles, component_id, kept: a row for each of the documents; ``group`` is null without words."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sketched(docs), "sketches")
    one_each = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(one_each.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # a bucket of any size: counts are summed in each task first, and the join with them is one that Spark splits where it is skewed
    sizes = scratch.keep(bands(classes, band_rows).groupBy("band").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = scratch.keep(bands(classes, band_rows).join(sizes.hint("merge"), "band"), "buckets")
    wanted = classes.join(shared.select("cid").distinct(), "cid", "left_semi")
    sets = scratch.keep(set_rows(docs, wanted), "sets")

    links = scratch.keep(verified(likely(hub_pairs(shared), classes, threshold), sets, threshold), "links")
    roots = scratch.keep(components(links, scratch), "roots")

    placed = shared.where(F.col("n") > HAND).join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("band", "cid", F.coalesce("root", "cid").alias("root"))
    more = scratch.keep(across(placed, classes, sets, scratch, threshold, band_rows), "more-links")
    scratch.drop(sets)

    name = lambda df, c: df.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    merged = scratch.keep(components(name(name(more, "a"), "b"), scratch), "merged")
    labelled = classes.select("cid", "key", "doc_id").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labelled = labelled.join(merged.select(F.col("id").alias("root"), F.col("root").alias("last")), "root", "left").withColumn("root", F.coalesce("last", "root"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = scratch.keep(labelled.join(least, "root").select("key", F.col("root").alias("group"), F.col("component"), F.lit(True).alias("found")), "components")
    scratch.drop(classes, shared, links, more, roots, merged)
    out = rows.select("doc_id", "text_hash", "key", "n_shingles").join(named, "key", "left").withColumn("component_id", F.when(F.col("found"), F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", "group", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, band_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return decided(docs, threshold, band_rows).drop("text_hash", "group")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: int = STAGE_THRESHOLD, band_rows: int = STAGE_ROWS) -> DataFrame:
    """One row of each group: the one with the least doc_id (null last), of equal ids the one with the least hash of the text, of rows that
    are equal in both any one. Documents without words are in no group and stay."""
    rows = decided(docs, threshold, band_rows).where("group is not null").select("group", "doc_id", "text_hash")
    copies = Scratch(spark).keep(rows.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n")), "near-duplicates")
    place = lambda: F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = copies.groupBy("group").agg(F.min(place()).alias("first"))
    stays = place().eqNullSafe(F.col("first"))
    # what goes, and what is there several times and of which one row stays
    touched = copies.join(first, "group").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_copy"), stays.alias("_stays"), "n").where("not _stays or n > 1").drop("n")
    touched = Scratch(spark).keep(touched.withColumn("_both", F.xxhash64("_gone", "_copy")), "touched")
    may_be = sieve(touched, "_both")
    safe = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))  # whatever the columns are called
    # only documents that may be touched are joined, and shuffled
    asked = may_be(F.xxhash64("_id", "_text"))
    joined = safe.where(asked).join(touched, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_text") == F.col("_copy")), "left")
    once = joined.where("_stays").groupBy("_id", "_text").agg(F.first("doc").alias("doc"))
    return safe.where(~asked).select("doc").unionByName(joined.where("_stays is null").select("doc")).unionByName(once.select("doc")).select("doc.*")


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: the same groups by whole sets of shingles as strings, all that share one compared
SQL = rf"""WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
  n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
  h AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
  edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.doc_id)
  SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
