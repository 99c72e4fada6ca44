"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

    P(word | context) = P(class | context) P(slot | class, context) P(slot | class, slot, context) ...

All words of the head, the ``HEAD`` most frequent of the training documents, are dealt to ``NEAR`` classes of about equal mass, each
of these to ``SLOTS`` parts of about equal mass, and so on until a part is one word: frequent words have short paths, and classes
and parts grow with the vocabulary. Every step of a path is a softmax whose logits are the log shares of the counts and the weights
of hashed features of the place in the tree and of the context: the word before (bigram), the two before (trigram), and, for the
class, the one before the last alone (skip). Words outside the head, known or not, are in ``FAR`` classes by hash, in which a word has its
smoothed share of the class's count: these are the rarest words of a corpus of more than HEAD. The model is a proper
distribution over known words and one unknown word for each far class.

Training: counts of all tokens of all training documents give the vocabulary, the shares and the unigram part. Weights are
then learned in ``ROUNDS`` rounds, each over its own part of the training documents, so that every training token is used once:
every task takes gradient steps over its documents (about ``PER_MODEL`` tokens or more) from the weights last agreed, and the
tasks' changes to each row of weights are averaged by how often they touched it (as blocks of rows in half precision, those of up
to ``DEALT`` tasks at once, as a stream; a change is off by at most 1 part in 2,048 of itself). There is a row of weights for every
four training tokens, ``MOST_ROWS`` at most. Weights and the head's counts are of bounded size, and are all that is broadcast or
collected. How documents lie in parts decides in which task they are learned, so that ``score`` (not ``base_score``) changes in
its last digits when the same rows are read in other parts or by another number of cores; read alike, it is the same.

Scoring: sparse batches in numpy, one pass. Counts of words outside the head are joined: a document sends each such word once.
Words are known by 64-bit hashes, which are made of all words of some texts at once.

Defined cases: a null or empty text is one token, the end; a null doc_id counts as the text "null" for the fold and stays null;
rows that repeat a document are scored and counted each; without training documents N and V are 0 and every word is unknown;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BINARY, BOOL, DOUBLE, INT, LONG, Scratch, batches_of, column, mixed, odd_constants, schema, signed, table, word_hashes

SMOOTH, HEAD, NEAR, FAR = 0.1, 1 << 19, 12, 4
CLASSES = SLOTS = NEAR + FAR
MOST_ROWS, BLOCK, ROUNDS, STEP, RATE = 1 << 18, 1 << 12, 2, 8192, 0.15
READ = 2048  # tokens scored, or rows moved, at once: they stay in a core's cache
DEALT = 256  # changes of one block that one task adds up
PER_MODEL = 1 << 22  # training tokens of a task in a round, at least
HELD = 10
LANES = 8  # of 8 bytes, in a word that is hashed with others
END = np.uint64(0x0E4D0F7E47000001)
START = np.uint64(0x57A2701000000001)
_M = odd_constants(8, 41)


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % HELD


def token_hashes(text: str | None) -> np.ndarray:
    return hashed([text.encode("utf-8", "surrogatepass") if text else None])[0]


def hashed(texts: list[bytes | None]) -> list[np.ndarray]:
    """Hashes of the tokens of each text, those of all texts at once: words are read 8 bytes at a time, long ones are hashed alone."""
    data = b"\n".join([b"", *(t or b"" for t in texts), b""]).lower()
    x = np.frombuffer(data, dtype=np.uint8)
    white = (x == 32) | (x - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.frombuffer(data + bytes(16 - len(data) % 8), dtype="<u8")

    def lane(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n bytes, 8 at most, that begin there: of the two aligned values that hold them."""
        k, bit = at >> 3, ((at & 7) << 3).astype(np.uint64)
        both = eights[k] >> bit | eights[k + 1] << np.uint64(1) << (np.uint64(63) - bit)
        return both << ((8 - np.minimum(n, 8)) << 3).astype(np.uint64)

    with np.errstate(over="ignore"):
        h = mixed(lane(first, size) * _M[0] + size.astype(np.uint64) * _M[1])
        long = np.flatnonzero(size > LANES * 8)
        h[long] = word_hashes([data[a : a + n] for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True)])
        more = np.flatnonzero((size > 8) & (size <= LANES * 8))
        for k in range(8, LANES * 8, 8):
            more = more[size[more] > k]
            h[more] = mixed((h[more] ^ lane(first[more] + k, size[more] - k)) * _M[2])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])  # the white space after each text
    last = np.searchsorted(first, ends) + np.arange(len(texts))
    out = np.full(len(h) + len(texts), END)
    word = np.ones(len(out), dtype=bool)
    word[last] = False
    out[word] = h
    return np.split(out, last[:-1] + 1)


def tokens_of(batch: pa.RecordBatch, texts: int = 64) -> list[np.ndarray]:
    """Hashes of the tokens of each text, so many texts at once that they stay in a core's cache."""
    utf8 = batch.column(batch.schema.names.index("text")).cast(pa.large_binary()).to_pylist()
    return [h for i in range(0, len(utf8), texts) for h in hashed(utf8[i : i + texts])]


def counted(docs: DataFrame) -> DataFrame:
    """(h, c): the counts of all tokens of the training documents, summed in each task first, in tables of bounded size."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, c = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[first], np.add.reduceat(c, first)

    def rows(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[i : i + (1 << 16)])), pa.array(c[i : i + (1 << 16)])], ["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches_of(batches):
            parts.append(tuple(np.unique(np.concatenate(tokens_of(batch)), return_counts=True)))
            size += len(parts[-1][0])
            if size > 1 << 21:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > 1 << 20:
                    yield from rows(*parts[0])
                    parts, size = [], 0
        if parts:
            yield from rows(*merged(parts))

    return docs.where(remainder() != 0).select("text").mapInArrow(run, schema(h=LONG, c=LONG)).groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What is known of words: totals, the head of the counts by hash, and the tree of classes and slots."""

    n: int
    v: int
    hashes: np.ndarray  # of the head, sorted
    logs: np.ndarray  # log10(count + SMOOTH)
    start: np.ndarray  # of the path of each word of the head, then of each far class
    depth: np.ndarray  # how many steps it has
    nodes: np.ndarray  # the steps of all paths: where in the tree (0 is its root, which chooses the class)
    digits: np.ndarray  # and the part chosen there
    shares: np.ndarray  # log share of each part, a row for each node
    salts: np.ndarray  # a hash of each node
    class_logs: np.ndarray  # log10 of the denominator of each far class

    @property
    def base_log(self) -> float:
        return float(np.log10(self.n + SMOOTH * (self.v + 1)))

    @property
    def rows(self) -> int:
        """Of weights: a power of 2, and whole blocks."""
        return min(MOST_ROWS, max(BLOCK, 1 << int(self.n // 4).bit_length()))

    @cached_property
    def buckets(self) -> tuple[np.uint64, np.ndarray, int]:
        """The head by the first bits of its hashes, about one to a bucket: the shift, where each bucket begins, the longest one."""
        bits = max(1, len(self.hashes).bit_length())
        shift = np.uint64(64 - bits)
        first = np.searchsorted((self.hashes >> shift).view(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        return shift, first, int(np.diff(first).max())

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash: its place in the head or -1, and the number of its path."""
        far = len(self.hashes) + (h >> np.uint64(62)).astype(np.int64)
        if not len(self.hashes):
            return np.full(len(h), -1), far
        shift, first, longest = self.buckets
        at = np.take(first, (h >> shift).view(np.int64)).astype(np.int64)
        ahead = np.arange(len(h))  # those whose hash is beyond the place looked at
        for _ in range(longest):
            place = at[ahead]
            ahead = ahead[np.take(self.hashes, place, mode="clip") < h[ahead]]
            at[ahead] += 1
        at[np.take(self.hashes, at, mode="clip") != h] = -1
        return at, np.where(at >= 0, at, far)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)


def tree(counts: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and depth of the paths, nodes, digits and shares for words of these counts and far classes of these masses."""
    order = np.argsort(-counts, kind="stable")
    mass = counts[order].astype(np.float64)

    def parts(mass: np.ndarray, group: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """The part, of n, of each word of a group: where the middle of its mass lies in that of the group."""
        sums = np.cumsum(mass)
        whole = np.add.reduceat(mass, first)
        below = sums - mass / 2 - (sums[first] - mass[first])[group]
        return np.clip((below / whole[group] * n).astype(np.int64), 0, n - 1)

    def logs(sums: np.ndarray) -> np.ndarray:
        """An empty part can't be told from an impossible one."""
        whole = sums.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sums > 0, np.log(sums / whole), -30.0).astype(np.float32)

    word, n = np.arange(len(mass)), 1
    cls = parts(mass, np.zeros(len(mass), dtype=np.int64), np.zeros(1, dtype=np.int64), NEAR) if len(mass) else word
    steps = [(np.append(word, len(mass) + np.arange(FAR)), np.zeros(len(mass) + FAR, dtype=np.int64), np.append(cls, NEAR + np.arange(FAR)))]
    shares = [logs(np.append(np.bincount(cls, mass, NEAR), far)[None, :])]
    key = cls
    while True:
        size = np.diff(np.append(starts(key), len(key)))
        several = np.repeat(size > 1, size)
        word, key = word[several], key[several]
        if not len(word):
            break
        first = starts(key)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        digit = parts(mass[word], group, first, SLOTS)
        steps.append((word, n + group, digit))
        key = group * SLOTS + digit
        shares.append(logs(np.bincount(key, mass[word], len(first) * SLOTS).reshape(-1, SLOTS)))
        n += len(first)
    words, nodes, digits = (np.concatenate(x) for x in zip(*steps, strict=True))
    names = np.append(order, len(mass) + np.arange(FAR))[words]
    by_word = np.argsort(names, kind="stable")  # steps of a word stay in their order
    depth = np.bincount(names, minlength=len(mass) + FAR)
    return np.cumsum(depth) - depth, depth, nodes[by_word].astype(np.int32), digits[by_word].astype(np.int8), np.concatenate(shares)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head is all words of at least some count, the least (of about 8 to a power of 2) that HEAD bounds."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(step.alias("s")).count().collect()  # at most 8 * 63 rows
    room, least = HEAD, None
    for s, n in sorted(((r.s, r["count"]) for r in steps), reverse=True):
        if n > room:
            break
        room, least = room - n, s
    if least is None:
        head = pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    else:
        head = counts.where(step >= least).select("h", "c").toArrow()
    h, c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    mass, kinds = np.zeros(FAR), np.zeros(FAR)
    tail = counts if least is None else counts.where(step < least)
    for r in tail.groupBy(F.shiftrightunsigned("h", 62).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r.k], kinds[r.k] = r.c, r.v
    start, depth, nodes, digits, shares = tree(c, mass + SMOOTH)
    with np.errstate(over="ignore"):
        salts = mixed(np.arange(len(shares), dtype=np.uint64) * _M[5] + _M[6])
    return Vocabulary(int(total.n), int(total.v), h, np.log10(c + SMOOTH), start.astype(np.int32), depth.astype(np.int32), nodes, digits, shares, salts, np.log10(mass + SMOOTH * (kinds + 1)))


class Batch:
    """The tokens of some documents: hashes, hashes of their features, places in the head, paths, and slots (-1 outside the head)."""

    def __init__(self, vocabulary: Vocabulary, hashes: list[np.ndarray]):
        self.h = np.concatenate(hashes)
        self.first = np.cumsum([0] + [len(x) for x in hashes[:-1]])
        before = lambda x: np.concatenate([[START], x[:-1]]).astype(np.uint64)
        one = before(self.h)
        one[self.first] = START
        two = before(one)
        two[self.first] = START
        with np.errstate(over="ignore"):
            self.features = [mixed(one * _M[0]), mixed(one * _M[3] + two * _M[4]), mixed(two * _M[1] + _M[2])]
        self.at, self.path = vocabulary.place(self.h)
        self.slot = np.where(self.at >= 0, 0, -1)


ONES = np.ones(SLOTS, dtype=np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


class Weights:
    """Rows of weights, one for each part of a node, by hash of node and feature."""

    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray | None = None):
        self.vocabulary = vocabulary
        n = vocabulary.rows
        self.shift = np.uint64(64 - (n.bit_length() - 1))
        self.rows = np.zeros((n, SLOTS), dtype=np.float32) if rows is None else rows
        self.squares = np.full(n, 1e-3, dtype=np.float32)
        self.touched = np.zeros(n, dtype=np.float32)

    def logits(self, nodes: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the parts of these nodes in these contexts, and which rows they are made of, a line for each feature."""
        salt = np.take(self.vocabulary.salts, nodes)
        rows = np.stack([(f + salt) >> self.shift for f in features]).view(np.int64)
        x = np.take(self.vocabulary.shares, nodes, axis=0)
        part = np.empty_like(x)
        for r in rows:
            np.take(self.rows, r, axis=0, out=part, mode="clip")
            x += part
        return np.clip(x, -60, 60, out=x), rows  # what exp can take

    def classes(self, b: Batch, s: slice) -> np.ndarray:
        return softmax(self.root(b, s)[1])

    def below(self, b: Batch, s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the steps below the root of the paths of some tokens: whose they are, the parts chosen, logits, rows."""
        v, path = self.vocabulary, b.path[s]
        depth = v.depth[path] - 1
        token = np.repeat(np.arange(len(path)), depth)
        at = np.arange(len(token)) + np.take(v.start[path] + 1 - (np.cumsum(depth) - depth), token)
        x, rows = self.logits(np.take(v.nodes, at), [np.take(f[s], token) for f in b.features[:2]])
        return token, np.take(v.digits, at), x, rows

    def root(self, b: Batch, s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes of some tokens, logits, rows."""
        path = b.path[s]
        x, rows = self.logits(np.zeros(len(path), dtype=np.int64), [f[s] for f in b.features])
        return self.vocabulary.digits[self.vocabulary.start[path]], x, rows

    def descend(self, rows: np.ndarray, error: np.ndarray) -> None:
        """One adaptive step: the errors that meet in a row of weights are summed first. Most are alone in theirs."""
        m = len(error)
        bits = m.bit_length()
        met = np.sort((rows << bits | np.arange(m)).ravel())  # rows are moved in their order
        row, i = met >> bits, met & ((1 << bits) - 1)
        first = starts(row)
        times = np.diff(np.append(first, len(row)))
        at, alone, several = row[first], np.flatnonzero(times == 1), np.flatnonzero(times > 1)
        norms = np.take(np.einsum("ij,ij->i", error, error), i[first])
        if len(several):
            meet = np.repeat(times > 1, times)
            pairs = np.take(error, i[meet], axis=0).view(np.complex64)  # two sums for one
            sums = np.add.reduceat(pairs, starts(row[meet]), axis=0).view(np.float32)
            norms[several] = np.einsum("ij,ij->i", sums, sums)
        norms /= SLOTS
        norms += np.take(self.squares, at)
        self.squares[at] = norms
        self.touched[at] += times
        rate = RATE / np.sqrt(norms)
        if len(several):
            self.move(at[several], sums, rate[several])
        for k in range(0, len(alone), READ):
            j = alone[k : k + READ]
            self.move(at[j], np.take(error, i[first[j]], axis=0), rate[j])

    def move(self, at: np.ndarray, gradient: np.ndarray, rate: np.ndarray) -> None:
        gradient *= rate[:, None]
        moved = np.take(self.rows, at, axis=0)
        moved -= gradient
        row = f"V{SLOTS * 4}"  # a row as one value, which numpy moves at once
        self.rows.view(row)[:, 0][at] = moved.view(row)[:, 0]

    def learn(self, b: Batch) -> None:
        for i in range(0, len(b.h), STEP):
            s = slice(i, i + STEP)
            for digit, x, rows in (self.root(b, s), self.below(b, s)[1:]):
                np.exp(x, out=x)
                x *= (1 / (x @ ONES))[:, None]
                x.ravel()[np.arange(0, x.size, SLOTS) + digit] -= 1
                self.descend(rows, x)

    def log10s(self, b: Batch) -> np.ndarray:
        """log10 P of each token, without log10(count + SMOOTH) for tokens outside the head."""
        out = np.empty(len(b.h))

        def logs(digit: np.ndarray, x: np.ndarray) -> np.ndarray:
            chosen = np.take(x.ravel(), np.arange(0, x.size, SLOTS) + digit)
            np.exp(x, out=x)
            return (chosen - np.log(x @ ONES)) / np.log(10)

        for i in range(0, len(b.h), READ):
            s = slice(i, i + READ)
            digit, x, _ = self.root(b, s)
            out[s] = logs(digit, x)
            token, digit, x, _ = self.below(b, s)
            out[s] += np.bincount(token, logs(digit, x), len(out[s]))
        far = b.slot < 0
        out[far] -= self.vocabulary.class_logs[b.path[far] - len(self.vocabulary.hashes)]
        return out


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights' rows after so many rounds of gradient steps."""
    spark = docs.sparkSession
    rows = np.zeros((vocabulary.rows, SLOTS), dtype=np.float32)
    blocks = len(rows) // BLOCK
    fields = schema(block=INT, salt=INT, touched=BINARY, change=BINARY)
    # what a task sends is of one size: its share of the documents is not to be smaller than that
    models = max(spark.sparkContext.defaultParallelism, vocabulary.n // (rounds * PER_MODEL))
    salts = -(-models // DEALT)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by block: no more than all blocks are held, whatever the number of rows."""
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, t, c in zip(column(batch, "block"), column(batch, "touched"), column(batch, "change"), strict=True):
                t, c = np.frombuffer(t, dtype=np.float32), np.frombuffer(c, dtype=np.float16).reshape(BLOCK, SLOTS)
                s = sums.setdefault(k, [np.zeros(BLOCK, dtype=np.float32), np.zeros((BLOCK, SLOTS))])
                s[0] += t
                s[1] += c * t[:, None].astype(np.float64)
        for k, (t, c) in sums.items():
            mean = (c / np.maximum(t, 1)[:, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([t.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], fields.names)

    for r in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            known, start = sent.value
            w = Weights(known, start.copy())
            for batch in batches_of(batches):
                w.learn(Batch(known, tokens_of(batch)))
            change = (w.rows - start).astype(np.float16)
            salt = TaskContext.get().partitionId() % salts
            for k in range(blocks):
                s = slice(k * BLOCK, (k + 1) * BLOCK)
                if w.touched[s].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([w.touched[s].tobytes()], pa.binary()), pa.array([change[s].tobytes()], pa.binary())], fields.names)

        mine = docs.where((remainder() != 0) & (F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == r)).select("text")
        once = mine.coalesce(models).mapInArrow(run, fields)
        if salts > 1:
            once = once.repartition("block", "salt").mapInArrow(added, fields)
        for x in once.repartition("block").mapInArrow(added, fields).collect():  # one row for each block
            s = slice(x.block * BLOCK, (x.block + 1) * BLOCK)
            rows[s] += np.frombuffer(x.change, dtype=np.float16).reshape(BLOCK, SLOTS)
        sent.unpersist()
    return rows


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = scratch.keep(counted(docs), "counts")
    known = vocabulary(counts)
    sent = spark.sparkContext.broadcast((known, trained(docs, known, rounds)))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (h is null), and one for each of its words outside the head (only row, h and n)."""
        vocabulary, rows = sent.value
        w = Weights(vocabulary, rows)
        for batch in batches_of(batches):
            hashes = tokens_of(batch)
            b = Batch(vocabulary, hashes)
            head, sizes = b.at >= 0, np.array([len(x) for x in hashes])
            logs = np.zeros(len(b.h))
            logs[head] = vocabulary.logs[b.at[head]]
            sums = lambda x, b=b: np.add.reduceat(x, b.first)
            base, model = sums(logs) - sizes * vocabulary.base_log, sums(w.log10s(b) + np.where(b.slot < 0, logs, 0))
            nothing = lambda n, kind: pa.nulls(n, kind)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes.astype(np.int64)), pa.array(sums(head.astype(np.int64))), pa.array(base), pa.array(model), nothing(n, pa.int64()), nothing(n, pa.int64())], names)
            doc = np.repeat(np.arange(n), sizes)[~head]
            tail = b.h[~head]
            if len(tail):
                order = np.lexsort((tail, doc))
                doc, tail = doc[order], tail[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tail[1:] != tail[:-1])))
                m = len(first)
                row = batch.column(0).to_numpy()[doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(row), nothing(m, pa.int64()), nothing(m, pa.bool_()), nothing(m, pa.int64()), nothing(m, pa.int64()), nothing(m, pa.float64()), nothing(m, pa.float64()), pa.array(signed(tail[first])), pa.array(np.diff(np.append(first, len(tail))))], names)

    fields = schema(row=LONG, doc_id=LONG, held_out=BOOL, n_tokens=LONG, n_known=LONG, base=DOUBLE, model=DOUBLE, h=LONG, n=LONG)
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (remainder() == 0).alias("held_out"), "text")
    both = scratch.keep(source.mapInArrow(run, fields), "scores")
    c = F.coalesce("c", F.lit(0))
    tail = both.where("h is not null").select("row", "h", "n").join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(SMOOTH))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    out = both.where("h is null").drop("h", "n").join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
