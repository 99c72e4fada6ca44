"""Phrases that stand together more often than their parts, mined by pivot partitioning.

Every word occurrence of a piece of text owns the phrases in which it is the rarest word (the leftmost of equals). What it owns lies
in the stretch of more frequent words around it: this fragment, all rarer words cut away, is routed to the pivot's partition, equal
fragments of a task as one row with a count. A partition mines its fragments alone and emits the phrases its pivots own, so that a
phrase is counted in one place and no occurrence twice.

How rare a word is comes from a table of fixed size (``SLOTS`` counts a row, two rows, the larger word where two meet), made of the
words that occur often enough, and broadcast: it decides only who owns a phrase, and cuts away words that are surely too rare, so that a
crowded table makes fragments longer and changes no count. A pivot of more than ``HOT`` occurrences has its fragments dealt to
several groups, whose partial counts are added.

Defined cases: a null or empty text has no words; a null language is ``und`` (and one with a row named so); repeated rows are counted
each; rows without an id count; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BOOL, LONG, STRING, Scratch, batches_of, column, mixed, odd_constants, schema, signed, table

LONGEST, LEAST, HELD, TOP = 4, 30, 80, 2000
SLOTS, HOT = 1 << 19, 1 << 18
TEXT, VOCABULARY, FRAGMENTS = 1 << 22, 1 << 19, 1 << 21  # bytes, words and fragments that a task holds at a time
SENT, MINED = 1 << 17, 1 << 17  # fragments that it writes, and takes phrases from, at a time
#: fixed values: what ends a piece of text, besides the full stop
ENDS = b",;:!?\n\x0b\x0c\r"
_STOP = b"."
_ENDS = bytes.maketrans(ENDS, _STOP * len(ENDS))
_MIX = odd_constants(2, 41)
BYTE = T.ByteType()


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of the texts in order, A-Z in lower case, and a full stop, which no word holds, where a piece ends."""
    return b".".join([*texts, b""]).lower().translate(_ENDS).replace(_STOP, b" . ").split()


class Words(dict):
    """Numbers for the words of a language as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def cut(text: bytes, size: int = TEXT) -> Iterator[bytes]:
    """A very long text in parts that end where pieces end; a piece stays whole."""
    while len(text) > size:
        marked = text.translate(_ENDS)
        at = marked.rfind(_STOP, 0, size)
        at = marked.find(_STOP, size) if at < 0 else at
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of about TEXT bytes; longer texts come in parts."""
    held, size = defaultdict(list), 0
    for batch in batches_of(batches, 64):
        for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
            for part in cut(text):
                held[lang].append(part)
                size += len(part)
                if size >= TEXT:
                    yield from held.items()
                    held, size = defaultdict(list), 0
    yield from held.items()


def given(docs: DataFrame, lang: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, and a row of the empty word for all occurrences of the language. Counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = defaultdict(Words), {}

        def out(lang: str) -> pa.RecordBatch:
            words, n = known.pop(lang), counts.pop(lang)
            n[0] = n[1:].sum()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), strings([b"", *list(words)[1:]]), pa.array(n[: len(words)])], ["lang", "word", "n"])

        for lang, texts in by_language(batches):
            ids = known[lang].numbers(tokens(texts))
            more = np.bincount(ids, minlength=len(known[lang]))
            before = counts.get(lang, np.zeros(0, dtype=np.int64))
            more[: len(before)] += before
            counts[lang] = more
            if sum(map(len, known.values())) > VOCABULARY:
                for x in list(known):
                    yield out(x)
        for x in list(known):
            yield out(x)

    rows = given(docs).mapInArrow(run, schema(lang=STRING, word=STRING, n=LONG))
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def slots(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of words in the table, by the unsigned hash."""
    return (h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def rarity(words: DataFrame, size: int = SLOTS) -> np.ndarray:
    """Two rows of ``size`` counts: of the words with an equal place, the most frequent one's. At most 2 * size rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes(column(b, "lang"), [w.encode() for w in column(b, "word")])
            a, c = slots(h, size)
            n = b.column(b.schema.names.index("n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c + size])), pa.concat_arrays([n, n])], ["slot", "n"])

    rows = words.mapInArrow(run, schema(slot=LONG, n=LONG)).groupBy("slot").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(2 * size, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(2, size)


def hashes(langs: list[str], words: list[bytes]) -> np.ndarray:
    h, seeds = xxhash.xxh64_intdigest, {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
    return np.fromiter((h(w, seeds[x]) for x, w in zip(langs, words, strict=True)), dtype=np.uint64, count=len(words))


def fragments(docs: DataFrame, common: np.ndarray, least: int = LEAST, longest: int = LONGEST, hot: int = HOT) -> DataFrame:
    """(lang, key, dealt, words, at, n): the stretches around pivots with how often they stand. ``key`` is a hash of the pivot (and of the deal of
    a hot one), ``at`` its place."""
    reach, size = longest - 1, common.shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(common)

    class Held:
        """A language's words in this task, their ranks, and the fragments that are not sent yet."""

        def __init__(self, lang: str):
            self.lang, self.words, self.parts, self.n = lang, Words(), [], 0
            self.rank, self.count = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.int64)

        def add(self, texts: list[bytes]) -> None:
            ids, known = self.words.numbers(tokens(texts)), len(self.rank)
            new = list(self.words)[known:]
            h = hashes([self.lang] * len(new), new)
            a, b = slots(h, size)
            count = np.minimum(sent.value[0][a], sent.value[1][b])
            rank = np.where(count >= least, np.minimum(count, (1 << 31) - 1), 0).astype(np.uint64)  # larger is more frequent, 0 is cut away
            self.rank = np.concatenate([self.rank, np.where(rank > 0, rank << np.uint64(32) | h >> np.uint64(32), 0)])
            self.count = np.concatenate([self.count, count])
            ids = np.concatenate([np.zeros(reach, dtype=np.int64), ids, np.zeros(reach, dtype=np.int64)])
            rank = self.rank[ids]
            p = np.flatnonzero(rank)
            mine = rank[p]
            columns, some = [], np.zeros(len(p), dtype=bool)
            for side, holds in ((-1, np.greater), (1, np.greater_equal)):
                alive = np.ones(len(p), dtype=bool)
                for d in range(1, reach + 1):
                    at = p + side * d
                    alive = alive & holds(rank[at], mine)
                    columns.append(np.where(alive, ids[at], 0))
                    some |= alive
            part = np.stack([*columns[reach - 1 :: -1], ids[p], *columns[reach:]])[:, some].astype(np.int32)
            self.parts.append(part)
            self.n += part.shape[1]

        def full(self) -> bool:
            return self.n > FRAGMENTS or len(self.words) > VOCABULARY

        def out(self) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(self.parts, axis=1)
            self.parts, self.n = [], 0
            if not x.shape[1]:
                return
            with np.errstate(over="ignore"):
                h = np.zeros(x.shape[1], dtype=np.uint64)
                for row in x:
                    h = (h + row.astype(np.uint64) + np.uint64(1)) * _MIX[0]
                    h ^= h >> np.uint64(29)
            order = np.argsort(h)
            x = x[:, order]
            first = np.flatnonzero(np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0)))  # equal hashes of different fragments only cost a row
            n = np.diff(np.append(first, x.shape[1]))
            x, h = x[:, first], h[order][first]
            del order
            names, deals = strings(list(self.words)), -(-self.count // hot)
            for k in range(0, len(n), SENT):
                yield self.batch(names, deals, x[:, k : k + SENT], h[k : k + SENT], n[k : k + SENT])

        def batch(self, names: pa.Array, deals: np.ndarray, x: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cells = [names.take(pa.array(row, mask=row == 0)) for row in x]
            joined = pc.binary_join_element_wise(*cells, " ", null_handling="skip")
            pivot = x[reach]
            many = deals[pivot].astype(np.uint64)
            with np.errstate(over="ignore"):
                key = mixed(self.rank[pivot] * _MIX[1] + mixed(h) % many)
            at = (x[:reach] > 0).sum(axis=0).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(n)), pa.array(signed(key)), pa.array(many > 1), joined, pa.array(at), pa.array(n.astype(np.int64))], ["lang", "key", "dealt", "words", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for lang, texts in by_language(batches):
            mine = held.setdefault(lang, Held(lang))
            mine.add(texts)
            if mine.full() or sum(x.n for x in held.values()) > FRAGMENTS:
                for x in list(held.values()):
                    yield from x.out()
                held = {}
        for x in held.values():
            yield from x.out()

    return given(docs).mapInArrow(run, schema(lang=STRING, key=LONG, dealt=BOOL, words=STRING, at=BYTE, n=LONG))


def owned(x: np.ndarray, size: np.ndarray, at: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases, of two words or more, of fragments that hold the pivot: (fragments' numbers, their words, a column each). ``x`` has the fragments'
    words, each from the left."""
    for length in range(2, longest + 1):
        for before in range(length):
            first = at - before
            some = np.flatnonzero((first >= 0) & (first + length <= size))
            if len(some):
                yield some, np.stack([x[first[some] + i, some] for i in range(length)])


def counted(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of word numbers, with the sums of their counts."""
    if x.max() < 1 << 16:
        key = np.zeros(x.shape[1], dtype=np.uint64)
        for row in x:
            key = key << np.uint64(16) | row.astype(np.uint64)
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
    else:
        order = np.lexsort(x)
        y = x[:, order]
        new = np.append(True, (y[:, 1:] != y[:, :-1]).any(axis=0))
    first = np.flatnonzero(new)
    return x[:, order[first]], np.add.reduceat(n[order], first)


def mined(parts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n) of the phrases that are frequent. A task takes the fragments pivot by pivot, some pivots at a time, each whole (or
    one deal of a hot one's, whose counts are still parts)."""
    columns = ["lang", "dealt", "words", "at", "n"]

    def found(lang: str, dealt: bool, some: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = pc.split_pattern(some["words"], " ").combine_chunks()
        words = lists.flatten().dictionary_encode()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        begins = np.cumsum(size) - size
        ids = words.indices.to_numpy()
        x = np.zeros((int(size.max()), len(size)), dtype=np.int64)
        for i in range(len(x)):
            has = size > i
            x[i, has] = ids[begins[has] + i]
        n, at = some["n"].to_numpy(), some["at"].to_numpy().astype(np.int64)
        by_length = {}
        for rows, phrase in owned(x, size, at, longest):
            by_length.setdefault(len(phrase), []).append((phrase, n[rows]))
        for same in by_length.values():
            phrase, many = counted(np.concatenate([p for p, _ in same], axis=1), np.concatenate([m for _, m in same]))
            keep = np.ones(len(many), dtype=bool) if dealt else many >= least
            if keep.any():
                cells = [words.dictionary.take(pa.array(row)) for row in phrase[:, keep]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(keep.sum())), pc.binary_join_element_wise(*cells, " "), pa.array(many[keep])], ["lang", "phrase", "n"])

    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        kinds = table.select(["lang", "dealt"]).group_by(["lang", "dealt"]).aggregate([]).to_pylist()
        for kind in kinds:
            mine = pc.and_(pc.equal(table["lang"], kind["lang"]), pc.equal(table["dealt"], kind["dealt"]))
            yield from found(kind["lang"], kind["dealt"], table.filter(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(b.schema.names.index("key")).to_numpy()
            changes = np.flatnonzero(key[1:] != key[:-1]) + 1
            edge = 0 if last is not None and key[0] != last else int(changes[0]) if len(changes) else None
            own = b.select(columns)
            if size >= MINED and edge is not None:  # the last pivot ends here
                yield from chunk([*held, own.slice(0, edge)])
                own = own.slice(edge)
                held, size = [], 0
            held.append(own)
            size += own.num_rows
            last = key[-1]
        if held:
            yield from chunk(held)

    local = parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema(lang=STRING, phrase=STRING, n=LONG))
    return local.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): by the cut that scores lowest, of equals the one after the fewest words."""
    counts = words.select("lang", F.col("word").alias("part"), "n").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n"))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    side = lambda c, n: counts.select("lang", F.col("part").alias(c), F.col("n").alias(n))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    both = both.withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (l + r)"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def not_held(phrases: DataFrame, share: int = HELD) -> DataFrame:
    """(lang, phrase) of those that no longer phrase holds in ``share`` per cent of their occurrences or more."""
    w = F.split("phrase", " ")
    longer = phrases.where(F.size(w) > 2).select("lang", "n", w.alias("w"))
    longer = longer.select("lang", "n", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k")).select("lang", "n", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    inner = longer.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase")).agg(F.max("n").alias("_m"))
    held = F.coalesce(F.col("_m").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * share, F.lit(False))
    return phrases.join(inner, ["lang", "phrase"], "left").where(~held).select("lang", "phrase")


def best(rows: DataFrame, top: int = TOP, deals: int = 64) -> DataFrame:
    """The first of each language with their rank. A language may have any share of the phrases: the best of each of ``deals`` parts first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = Window.partitionBy("lang", "_deal").orderBy(*order)
    few = rows.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(deals))).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_deal", "_r")


def collocations(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, share: int = HELD, top: int = TOP, slots: int = SLOTS, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    words = scratch.keep(word_counts(docs).where((F.col("n") >= least) | (F.col("word") == "")), "words")
    totals, frequent = words.where("word = ''").select("lang", F.col("n").alias("n")), words.where("word <> ''").where(F.col("n") >= least)
    phrases = scratch.keep(mined(fragments(docs, rarity(frequent, slots), least, longest, hot), least, longest), "phrases")
    rows = scored(phrases, frequent).join(not_held(phrases, share), ["lang", "phrase"], "left_semi")
    return best(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), Scratch(spark))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
q AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM q),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS n FROM g GROUP BY 1, 2, 3),
tot AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
cu AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS k FROM c),
sc AS (SELECT cu.lang, cu.phrase, a, cu.k, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score FROM cu
  JOIN f x ON x.lang = cu.lang AND x.phrase = array_to_string(w[1:cu.k], ' ') JOIN f y ON y.lang = cu.lang AND y.phrase = array_to_string(w[cu.k + 1:], ' ')),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
inn AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM s) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, tot.n AS n, score
FROM low LEFT JOIN inn USING (lang, phrase) JOIN tot USING (lang) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a QUALIFY rank <= 2000
"""
