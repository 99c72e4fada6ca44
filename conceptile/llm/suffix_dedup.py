"""Removes passages that stood earlier in the corpus, found by suffix arrays over shards that equal passages share.

Every window of ``LENGTH`` bytes has an anchor, its run of ``GRAM`` bytes with the least hash (the leftmost of equals), which hangs on
the window's bytes alone: equal windows have equal anchors, at the same distance. Neighbouring windows with one anchor are a segment,
and segments of one anchor go to one shard, so that all places of a window meet there and matches never cross documents.

1. Segments (anchor, hash of the bytes, place) are range-partitioned by all three, however often an anchor occurs. Anchors that
   occur once can't repeat; segments equal byte for byte are one string with its first place, and what stands later goes.
2. Anchors whose segments differ are compared: their bytes are fetched, and each shard of about ``SHARD`` bytes sorts its suffixes by
   induced sorting; runs of permuted common prefixes of ``LENGTH`` or more are equal windows, of which the first place stays.
3. An anchor with over ``CONTENTS`` different segments, as a phrase that many documents share, isn't sent to one shard: its windows
   are segments of their own, with their own hash as anchor, and go through step 1 again.
4. Removed windows of a document are joined into spans, and cut.

Defined cases: a null text is empty; a null id counts as the least one; rows of one id are told apart by their text (23 bits of its
hash) and ordered by that; rows of one id and text are one document, and each gets its result; documents shorter than ``LENGTH``
keep all; runs of one byte are like other text (all but their first ``LENGTH`` bytes go); an empty table has no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BINARY, LONG, Scratch, batches_of, column, mixed, odd_constants, schema, sieve, signed, table
from .suffix_sorting import common_prefixes, runs, suffix_array

LENGTH, GRAM = 100, 32
PIECE, SHARD, CONTENTS = 1 << 17, 1 << 18, 1 << 10  # bytes that are hashed, and sorted, at a time; different segments of an anchor
_BYTE = odd_constants(256, 5)
_BASE = 0x9E3779B97F4A7C15
PLACE = schema(id=LONG, at=LONG)
FOUND = schema(kind=T.IntegerType(), h=LONG, c=LONG, id=LONG, at=LONG)
LATER, DIFFERENT, EDGE = 0, 1, 2


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = powers(_BASE, PIECE + (1 << 12)), powers(pow(_BASE, -1, 2**64), PIECE + (1 << 12))


class Hashed:
    """Hashes of any stretch of some bytes, from sums up to each place."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * _UP[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * _DOWN[start])


def segments(data: np.ndarray, window_ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor's hash, hash of the bytes, first window, windows) of texts laid end to end, at most PIECE bytes of them and a window's overlap.
    ``window_ends`` says by place whether a window that begins there ends within its text."""
    n = len(data)
    h = Hashed(data)
    place = np.arange(n - gram + 1)
    key = h(place, place + gram)
    low = np.uint64(20)  # bits of the place, so that the least is the leftmost of equals
    least = key >> low << low | place.astype(np.uint64)
    reach, span = length - gram + 1, 1
    whole = len(least)
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    starts = whole - reach + 1
    least = np.minimum(least[:starts], least[reach - span : reach - span + starts])
    windows = np.flatnonzero(window_ends[:starts])
    anchor = (least[windows] & np.uint64((1 << 20) - 1)).astype(np.int64)
    first, many = runs(anchor)
    start = windows[first]
    return key[anchor[first]], h(start, start + many + length - 1), start, many


def packed(hash23: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A place in a document as one number: 23 bits of its text's hash, 32 of the first window, 8 of how many windows."""
    return hash23 << np.int64(40) | start << np.int64(8) | windows


def text_hash(text: str = "text") -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 41)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, th, text) with the id that is used for order, and the text as bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"), text.alias("text")).withColumn("th", text_hash())


def pieces(rows: Iterator[tuple[int, int, bytes]], length: int, piece: int = PIECE) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(id, th, offset, bytes) in lists of about ``piece`` bytes; a longer text comes in overlapping parts."""
    held, size = [], 0
    for id_, th, text in rows:
        if len(text) < length:
            continue
        for at in range(0, max(1, len(text) - length + 1), piece):
            part = text[at : at + piece + length - 1]
            if held and size + len(part) > piece + length - 1:
                yield held
                held, size = [], 0
            held.append((id_, th, at, part))
            size += len(part)
    if held:
        yield held


def all_segments(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(h, c, id, at) of every segment of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            for b in batches_of(batches, 64):
                yield from zip(column(b, "id"), column(b, "th"), column(b, "text"), strict=True)

        held, size = [], 0
        for some in pieces(rows(), length, piece):
            sizes = np.array([len(p[3]) for p in some])
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(p[3] for p in some), dtype=np.uint8)
            inside = np.arange(len(data)) + length <= np.repeat(ends, sizes)
            h, c, start, many = segments(data, inside, length)
            doc = np.searchsorted(ends, start, side="right")
            id_, th, at = (np.array([p[k] for p in some], dtype=np.int64) for k in range(3))
            held.append((signed(h), signed(c), id_[doc], packed(th[doc], start - (ends - sizes)[doc] + at[doc], many)))
            size += len(h)
            if size > 1 << 17:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["h", "c", "id", "at"])

    return docs.select("id", "th", "text").mapInArrow(run, schema(h=LONG, c=LONG, id=LONG, at=LONG))


def repeated(rows: DataFrame) -> DataFrame:
    """(kind, h, c, id, at): of anchors that occur twice, LATER places of equal segments, and the first places of DIFFERENT ones. Ranges are
    read in order; an anchor at the edge of a range may go on in the next, and the first places of its segments come back as EDGE."""
    order = ["h", "c", "id", "at"]

    def batch(kind: np.ndarray, x: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (kind.astype(np.int32), *x)], FOUND.names)

    def edge(x: list[np.ndarray], lead: list[np.ndarray] | None = None) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """Of rows of an anchor that other ranges may have too: only the first place here of each segment is in question. ``lead`` is the one of
        the segment that the rows before ended with; the last one comes back."""
        n = 0 if lead is None else 1
        x = x if lead is None else [np.concatenate(v) for v in zip(lead, x, strict=True)]
        _, c, id_, at = x
        first = np.append(True, c[1:] != c[:-1])
        of = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        keep = first | (id_ != id_[of]) | (at != at[of])
        keep[:n] = False
        return batch(np.where(first, EDGE, LATER)[keep], [v[keep] for v in x]), [v[of[-1] : of[-1] + 1] for v in x]

    def judged(x: list[np.ndarray]) -> pa.RecordBatch:
        """Of rows of whole anchors."""
        h, c, id_, at = x
        first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        begins, many = runs(h)
        different = np.repeat(np.add.reduceat(first, begins) > 1, many)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = ~first & ((id_ != id_[lead]) | (at != at[lead]))  # a row that is there twice is one document
        keep = later | (first & different)
        return batch(np.where(first, DIFFERENT, LATER)[keep], [v[keep] for v in x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, lead, held = None, None, [np.zeros(0, dtype=np.int64)] * 4
        for b in batches:
            if not b.num_rows:
                continue
            x = [np.concatenate([v, b.column(i).to_numpy(zero_copy_only=False)]) for i, v in enumerate(held)]
            first = x[0][0] if first is None else first
            n = np.searchsorted(x[0], first, side="right")
            if n:
                out, lead = edge([v[:n] for v in x], lead)
                yield out
                x = [v[n:] for v in x]
            last = runs(x[0])[0][-1] if len(x[0]) else 0
            if last:
                yield judged([v[:last] for v in x])
            held = [v[last:] for v in x]
        if len(held[0]):
            yield edge(held)[0]

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(run, FOUND)


def resolved(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, at) of later places, and (h, id, at) of the first places of segments that differ and share an anchor."""
    edges = found.where(F.col("kind") == EDGE)
    firsts = edges.groupBy("h", "c").agg(F.min(F.struct("id", "at")).alias("f"))
    shared = firsts.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
    later = edges.join(firsts, ["h", "c"]).where((F.col("id") != F.col("f.id")) | (F.col("at") != F.col("f.at")))
    different = firsts.join(shared, "h", "left_semi").select("h", "f.id", "f.at")
    take = lambda kind, *names: found.where(F.col("kind") == kind).select(*names)
    return take(LATER, "id", "at").unionByName(later.select("id", "at")), take(DIFFERENT, "h", "id", "at").unionByName(different)


def fetched(docs: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, c, id, at, bytes): the segments that are wanted, with their bytes; those that are to be taken apart as their windows, with hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches_of(batches, 16):
            for id_, th, text, asked in zip(*(column(b, x) for x in ("id", "th", "text", "wanted")), strict=True):
                for x in asked:
                    start, many = x["at"] >> 8 & 0xFFFFFFFF, x["at"] & 255
                    if not x["apart"]:
                        rows.append((x["h"], None, id_, x["at"], text[start : start + many + length - 1]))
                        size += many + length
                        continue
                    for i in range(start, start + many):
                        h = xxhash.xxh3_128_intdigest(text[i : i + length])
                        rows.append(((h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, id_, th << 40 | i << 8 | 1, None))
                    size += many * 40
                if size > 1 << 22:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "c", "id", "at", "bytes"])

    return docs.join(wanted, ["id", "th"]).select("id", "th", "text", "wanted").mapInArrow(run, schema(h=LONG, c=LONG, id=LONG, at=LONG, bytes=BINARY))


def repeats(strings: list[bytes], ids: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string's number, packed place) of the windows that stand earlier in a shard, in runs of neighbours."""
    sizes = np.array([len(x) + 1 for x in strings])
    text = np.frombuffer(b"".join(x + b"\0" for x in strings), dtype=np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0  # no byte
    sa = suffix_array(text, 257)
    prefix = common_prefixes(text, sa)
    whose = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    window = offset < (at & 255)[whose]
    group = np.cumsum(prefix[sa] < length)
    some = window[sa]
    group, place = group[some], sa[some]
    owner = whose[place]
    doc_order = np.lexsort((at >> 40, ids))
    new = np.append(False, (ids[doc_order][1:] != ids[doc_order][:-1]) | (at[doc_order][1:] >> 40 != at[doc_order][:-1] >> 40))
    doc = np.empty(len(strings), dtype=np.int64)
    doc[doc_order] = np.cumsum(new)
    start = (at >> 8 & 0xFFFFFFFF)[owner] + offset[place]
    order = np.lexsort((start, doc[owner], group))
    group, place, d, start = group[order], place[order], doc[owner][order], start[order]
    begins, many = runs(group)
    lead = np.repeat(begins, many)
    gone = np.sort(place[(d != d[lead]) | (start != start[lead])])
    begins, many = runs(gone - np.arange(len(gone)))
    first = gone[begins]
    owner = whose[first]
    return owner, packed(at[owner] >> 40, (at >> 8 & 0xFFFFFFFF)[owner] + offset[first], many)


def compared(rows: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(id, at) of the windows that the suffix arrays of the shards find earlier. A shard holds whole anchors, read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            ids, at = (np.array(x, dtype=np.int64) for x in (held[1], held[2]))
            owner, gone = repeats(held[3], ids, at, length)
            return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(gone)], ["id", "at"])

        held, size = ([], [], [], []), 0
        for b in batches_of(batches, 4096):
            for row in zip(*(column(b, x) for x in ("h", "id", "at", "bytes")), strict=True):
                if size > shard and row[0] != held[0][-1]:
                    yield found()
                    held, size = ([], [], [], []), 0
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                size += len(row[3])
        if size:
            yield found()

    return rows.select("h", "id", "at", "bytes").repartition("h").sortWithinPartitions("h", "id", "at").mapInArrow(run, PLACE)


def per_document(places: DataFrame, *columns: str) -> DataFrame:
    """(id, th, wanted): the places of each document that has some."""
    return places.groupBy("id", F.shiftright("at", 40).alias("th")).agg(F.collect_list(F.struct("at", *columns)).alias("wanted"))


def cut(docs: DataFrame, places: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, spans, kept): the removed spans of documents that have some (byte places, end exclusive, none touching another), and
    what remains."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 16):
            spans, kept = [], []
            for text, at in zip(column(b, "text"), column(b, "at"), strict=True):
                at = np.sort(np.array(at, dtype=np.int64) & (1 << 40) - 1)
                start = at >> 8
                end = np.maximum.accumulate(start + (at & 255) + length - 1)
                new = np.append(True, start[1:] > end[:-1])
                start, end = start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(start, end, strict=True)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *end], [*start, len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "th", "spans", "kept"])

    fields = T.StructType([*schema(id=LONG, th=LONG).fields, T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    return docs.join(places, ["id", "th"]).select("id", "th", "text", F.col("wanted.at").alias("at")).mapInArrow(run, fields)


def with_some(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents that may have places: most others needn't be shuffled for the join."""
    doc = F.xxhash64("id", "th")
    return docs.where(sieve(places.select(doc.alias("_d")), "_d")(doc))


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, contents: int = CONTENTS, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """(id, th, spans, kept) of the keyed documents of which something is removed."""
    found = scratch.keep(repeated(all_segments(docs, length, piece)), "segments")
    later, different = resolved(found)
    crowded = different.groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > contents).select("h", F.lit(True).alias("apart"))
    wanted = different.join(crowded, "h", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    wanted = scratch.keep(per_document(wanted, "h", "apart"), "wanted")
    strings = scratch.keep(fetched(with_some(docs, wanted), wanted, length), "strings")
    windows = scratch.keep(repeated(strings.where("bytes is null").drop("bytes")), "windows")
    places = later.unionByName(resolved(windows)[0]).unionByName(compared(strings.where("bytes is not null"), length, shard))
    places = scratch.keep(per_document(places), "places")
    scratch.drop(found, wanted, strings, windows)
    return cut(with_some(docs, places), places, length)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    changed = without_repeats(docs, Scratch(spark))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    changed = changed.select("id", "th", F.size("spans").cast("long").alias("n_spans"), size("kept").alias("_left"), F.sha2("kept", 256).alias("_sha")).dropDuplicates(["id", "th"])
    whole = docs.select("doc_id", "id", "th", size("text").alias("n_bytes"), F.sha2("text", 256).alias("_whole"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return whole.join(changed, ["id", "th"], "left").select("doc_id", "n_bytes", n(F.col("n_bytes") - F.col("_left")).alias("n_removed"), n(F.col("n_spans")).alias("n_spans"), F.coalesce("_sha", "_whole").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM s),
t AS (SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS x, sum(b - a) AS n, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
