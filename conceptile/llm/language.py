"""Language identification by hierarchical discrimination.

A text is the bag of its hashed 1- to 4-byte n-grams over lower-cased letters, as root counts of unit length. A linear support
vector machine for each family of languages (one against the rest) picks the family; within a family of several languages, one
machine for each pair votes, ties going to the larger sum of margins and then to the name. All machines are trained on the
driver by dual coordinate descent on a bounded sample: at most ``PER_LANGUAGE`` labelled texts of each language, picked by
hashes, so that neither the number of rows nor a hot language or source changes its size; it grows with the number of languages
only (16 kB a text). Predictions read whole texts, in one pass without a shuffle.

Families are a parameter; a language in none of them is a family of its own.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null text or language teach nothing;
a null doc_id counts as the text "null" for the fold and stays null; with no labelled row at all every text is ``und``; with one
language, it is predicted with score 1; repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BINARY, BOOL, DOUBLE, LONG, STRING, batches_of, column, odd_constants, schema, table

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "uk", "sk", "bg", "hr", "sr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
}
PER_LANGUAGE, BITS, GRAMS, C, EPOCHS, PIECE = 600, 12, 4, 10.0, 30, 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: ASCII that isn't a letter becomes a space; other bytes are parts of letters nearly always
_CLEAN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)
_MIX = odd_constants(GRAMS + 1, 11)


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers written as single signs are none."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def vector(text: str) -> np.ndarray:
    """Unit vector of root counts of the hashed n-grams of the whole text between spaces, read in pieces: each n-gram is counted in the
    piece that its last byte is in."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(1 << BITS, dtype=np.float64)
    before = np.zeros(0, dtype=np.uint8)  # the last bytes that were kept
    with np.errstate(over="ignore"):
        for at in range(0, max(1, len(raw)), PIECE):
            part = _CLEAN[raw[at : at + PIECE]]
            part = np.concatenate([before if at else [32], part, [32] if at + PIECE >= len(raw) else []]).astype(np.uint8)
            keep = np.ones(len(part), dtype=bool)
            keep[1:] = (part[1:] != 32) | (part[:-1] != 32)  # runs of spaces count once
            keep[: len(before)] = True
            part, old = part[keep], len(before)
            before = part[1 - GRAMS :]
            part = part.astype(np.uint64)
            code = np.zeros(len(part), dtype=np.uint64)
            for n in range(1, GRAMS + 1):
                if len(part) < n:
                    break
                code = code[: len(part) - n + 1] + part[n - 1 :] * (np.uint64(1) << np.uint64(8 * (n - 1)))
                new = code[max(0, old - n + 1) :]
                counts += np.bincount(((new + np.uint64(n) * _MIX[GRAMS]) * _MIX[n] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    out = np.sqrt(counts)
    norm = np.sqrt(out @ out)
    return (out / norm if norm else out).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = C, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last for the constant, of an L1-loss linear support vector machine; classes weigh the same in all."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    upper = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    q, a, w, rng = (x * x).sum(1), np.zeros(len(y)), np.zeros(x.shape[1]), np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(a[i] - g / q[i], 0.0), upper[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]) * q[i])
                a[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES):
        of = {lang: f for f, members in families.items() for lang in members}
        names = np.array(langs)
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(of.get(lang, f"own:{lang}"), []).append(lang)
        family = np.array([of.get(lang, f"own:{lang}") for lang in langs])
        self.families = sorted(self.members)
        machine = lambda mask, y: svm(x[mask], y).astype(np.float32)
        everything = np.ones(len(names), dtype=bool)
        two = len(self.families) == 2  # then the second family's machine is the first's, turned round
        by = {f: machine(everything, np.where(family == f, 1.0, -1.0)) for f in self.families[: 1 if two else None]} if len(self.families) > 1 else {}
        if two:
            by[self.families[1]] = -by[self.families[0]]
        self.by_family = by
        self.by_pair = {(a, b): machine((names == a) | (names == b), np.where(names == a, 1.0, -1.0)[(names == a) | (names == b)]) for m in self.members.values() for a, b in combinations(m, 2)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        v, sure = np.append(vector(text), np.float32(1)), 1.0
        family = self.families[0]
        if self.by_family:
            margins = {f: float(w @ v) for f, w in self.by_family.items()}
            family = max(self.families, key=lambda f: margins[f])
            sure = 1 / (1 + np.exp(-2 * margins[family]))
        members = self.members[family]
        votes = {m: [0, 0.0] for m in members}
        for a, b in combinations(members, 2):
            m = float(self.by_pair[a, b] @ v)
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(members, key=lambda m: votes[m])  # the first by name among equals
        if len(members) > 1:
            sure *= 1 / (1 + np.exp(-2 * votes[best][1] / (len(members) - 1)))
        return best, float(sure)


def fold(column_: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column_).cast("string"), F.lit("null")).cast("binary")) % 4


def train(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = PER_LANGUAGE) -> Model:
    """Rows are counted by language first; hashes of rows then pick about twice the bound of each, and a rank cuts that down, so that
    a language's rows never meet in one task. Picked texts are turned to vectors before they are sent to the driver."""
    known = docs.where((fold() != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("h")).collect()  # one row a language
    if not sizes:
        return Model(np.zeros((0, 1)), [], families)
    own = lambda f: F.element_at(F.create_map(*[F.lit(v) for r in sizes for v in (r.lang, f(r))]), F.col("lang"))
    share = own(lambda r: min(1.0, (2 * per_language + 64) / r.n))
    some = known.where((F.shiftrightunsigned("h", 11).cast("double") < share * float(1 << 53)) | (F.col("h") == own(lambda r: r.h)))
    # equal rows come together or not at all: each task ranks its own first, before any row is moved
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vector(t).tobytes() for t in column(batch, "text")], pa.binary())], ["lang", "v"])

    got = picked.mapInArrow(run, schema(lang=STRING, v=BINARY)).collect()
    got.sort(key=lambda r: (r.lang, bytes(r.v)))
    x = np.array([np.frombuffer(r.v, dtype=np.float32) for r in got], dtype=np.float32).reshape(len(got), -1)
    return Model(x, [r.lang for r in got], families)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            got = [sent.value.predict(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (fold() == 2).alias("held_out"), "text").mapInArrow(run, schema(doc_id=LONG, held_out=BOOL, lang_pred=STRING, score=DOUBLE))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
