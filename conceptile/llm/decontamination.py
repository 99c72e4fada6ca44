"""Benchmark decontamination by greedy string tiling.

Texts become lower-cased runs of word characters. Windows of ``LEAST`` words of the benchmark, by their Karp-Rabin hashes, are the
seeds; documents are scanned for them, and each pair of a document and an item that share one is tiled: again and again the
longest match of words that no tile has taken, at least ``LEAST`` long, becomes a tile. The hashes are running: sums over all words
before a place, from which that of any window of any width is two look-ups; so the longest width at which free windows of both
match is searched by halving, and all matches of that width become tiles before the next. No pairs of places are listed, and the
work grows with the seeds, however often words repeat. Tiles may lie in any order, so that reordered passages are caught. A document is contaminated by an item when tiles cover ``COVERAGE`` of the item's words, or when
one tile has ``PASSAGE`` words or more: so long a verbatim passage is a leak however much longer the item is.

The benchmark is the stated query set. It goes out in blocks of at most ``BLOCK_WORDS`` words (one item may be longer), each
against all documents, in one pass without a shuffle; its size bounds nothing but the number of passes.

Defined cases: a null text or item, or one without words, matches nothing; an item of fewer than ``LEAST`` words is one seed, and
must occur whole; repeated items with the same id and text count once, repeated documents each; a null doc_id or item_id stays
null in the result; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOUBLE, LONG, STRING, Scratch, batches_of, column, mixed, schema, table

LEAST, COVERAGE, PASSAGE, BLOCK_WORDS = 5, 0.8, 50, 1 << 21
TOKEN = re.compile(r"\w+")
RADIX = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
Tile = tuple[int, int, int]  # first word in the item, in the document, length


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


class Running:
    """Karp-Rabin hashes of all windows of any width: sums of words times powers of the radix, from which a window's is what its
    last word adds to what its first had, turned to the same power."""

    powers = backs = np.ones(1, dtype=np.uint64)  # of the radix and of its inverse; as many as the longest text had words

    def __init__(self, wh: np.ndarray):
        n = len(wh)
        if n > len(Running.powers):
            size = max(n, 2 * len(Running.powers))
            one = np.ones(1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                Running.powers, Running.backs = (np.cumprod(np.append(one, np.full(size - 1, x)), dtype=np.uint64) for x in (RADIX, BACK))
        with np.errstate(over="ignore"):
            self.sums = np.append(np.zeros(1, dtype=np.uint64), np.cumsum(wh * Running.backs[:n], dtype=np.uint64))

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the windows of so many words that begin at these places."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[at + width] - self.sums[at]) * Running.powers[at])


def karp_rabin(wh: np.ndarray, width: int, running: Running | None = None) -> np.ndarray:
    """Hashes of all windows of so many words."""
    n = len(wh) - width + 1
    return wh[:0] if n <= 0 else (running or Running(wh)).windows(np.arange(n), width)


def lengths(places: np.ndarray, least: int) -> np.ndarray:
    """For sorted places of seeds: how many words each run of neighbouring seeds covers from there on."""
    last = np.flatnonzero(np.append(places[1:] != places[:-1] + 1, True))
    return places[last[np.searchsorted(last, np.arange(len(places)))]] - places + least


class Free:
    """The words of a text that no tile has taken."""

    def __init__(self, places: np.ndarray, reach: np.ndarray, size: int):
        self.places, self.reach, self.taken = places, reach, np.zeros(size, dtype=bool)
        self.before: np.ndarray | None = None

    def take(self, at: int, width: int) -> None:
        self.taken[at : at + width] = True
        self.before = None

    def is_free(self, at: int, width: int) -> bool:
        return not self.taken[at : at + width].any()

    def windows(self, width: int) -> np.ndarray:
        """The places at which so many free words may match."""
        if self.before is None:
            self.before = np.append(0, np.cumsum(self.taken))
        some = self.places[self.reach >= width]
        return some[self.before[some + width] == self.before[some]]


def tiles(item: list[str], text: list[str], at: np.ndarray, least: int = LEAST, sums: tuple[Running, Running] | None = None) -> list[Tile]:
    """Greedy tiling, given the places in the text at which a window of ``least`` words may match one of the item. Of matches of one
    length the first in the item, then in the text, becomes a tile."""
    mine, its = sums or (Running(hashes(item)), Running(hashes(text)))
    n = len(item) - least + 1
    p_free, t_free = Free(np.arange(n), len(item) - np.arange(n), len(item)), Free(at, lengths(at, least), len(text))
    out: list[Tile] = []

    def match(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the item and in the text whose free windows have hashes in common, and the hashes."""
        p, t = p_free.windows(width), t_free.windows(width)
        hp, ht = mine.windows(p, width), its.windows(t, width)
        p_in, t_in = np.isin(hp, ht), np.isin(ht, hp)
        return p[p_in], hp[p_in], t[t_in], ht[t_in]

    width = int(min(len(item), t_free.reach.max(initial=0)))
    while width >= least:
        low, found = least, match(least)
        if not len(found[0]):
            break
        while low < width:  # windows of ``low`` match, those of more than ``width`` don't
            middle = (low + width + 1) // 2
            more = match(middle)
            if len(more[0]):
                low, found = middle, more
            else:
                width = middle - 1
        p, hp, t, ht = found
        order = np.argsort(ht, kind="stable")
        t, ht = t[order], ht[order]
        first, last = np.searchsorted(ht, hp), np.searchsorted(ht, hp, side="right")
        passed: dict[int, int] = {}  # places of a hash that were taken are not looked at again
        for i, a, b in zip(p.tolist(), first.tolist(), last.tolist(), strict=True):
            if not p_free.is_free(i, low):
                continue
            k = passed.get(a, a)
            while k < b and not t_free.is_free(int(t[k]), low):
                k += 1
            passed[a] = k
            for j in (int(t[x]) for x in range(k, b)):
                if t_free.is_free(j, low) and item[i : i + low] == text[j : j + low]:
                    out.append((i, j, low))
                    p_free.take(i, low)
                    t_free.take(j, low)
                    break
        width = low - 1
    return sorted(out)


class Block:
    """Some items of the benchmark, and their seeds by width."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = LEAST):
        self.least = least
        self.items = [(i, w) for i, w in ((i, tokens(t)) for i, t in items) if w]
        found: dict[int, list] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            width = min(least, len(w))
            found[width].append((np.unique(karp_rabin(hashes(w), width)), k))
        self.seeds = {}
        for width, parts in found.items():
            h, k = np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k) for p, k in parts])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 16, dtype=bool)
            bits[(h >> np.uint64(48)).astype(np.int64)] = True
            self.seeds[width] = (h[order], k[order], bits)

    def matches(self, text: str | None) -> Iterator[tuple[int | None, list[Tile], int]]:
        """(item_id, tiles, words of the item) for each item that shares a seed."""
        words = tokens(text)
        wh = hashes(words)
        its = Running(wh)
        for width, (h, k, bits) in self.seeds.items():
            windows = karp_rabin(wh, width, its)
            some = np.flatnonzero(bits[(windows >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(h, windows[some]), np.searchsorted(h, windows[some], side="right")
            places = defaultdict(list)
            for t, a, b in zip(some[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                for i in k[a:b]:
                    places[int(i)].append(int(t))
            for i, at in sorted(places.items()):
                item_id, item = self.items[i]
                yield item_id, tiles(item, words, np.array(at), width, (Running(hashes(item)), its)), len(item)


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    part, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").distinct().toLocalIterator():
        n = len(tokens(r.text))
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, block_words: int = BLOCK_WORDS, passage: int = PASSAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, tiled_words, item_words, tiles (item:document:length in words, comma-joined)."""
    spark = docs.sparkSession
    scratch, out = Scratch(spark), None
    fields = schema(doc_id=LONG, item_id=LONG, coverage=DOUBLE, n_tiles=LONG, tiled_words=LONG, item_words=LONG, tiles=STRING)
    for part in blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(Block(part, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(batches):
                rows = []
                for d, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                    for item, found, n in sent.value.matches(t):
                        covered = sum(x[2] for x in found)
                        if covered >= coverage * n or max((x[2] for x in found), default=0) >= passage:
                            rows.append((d, item, covered / n, len(found), covered, n, ",".join(f"{p}:{q}:{k}" for p, q, k in found)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], fields.names)

        found = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, fields), "contaminated")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], fields) if out is None else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates; rows without an id stay only if no text without an id is contaminated."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct()
    safe = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_id"))  # whatever the columns are called
    return safe.join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti").select("doc.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
