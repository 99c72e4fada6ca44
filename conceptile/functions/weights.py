"""Term weights: SMART schemes with a BM25 saturation around the term frequency.

A scheme has three letters: term frequency (n l a b L), inverse document frequency (n t p b), norm (n c b).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TF = {
    "n": lambda tf, most, mean: tf,
    "l": lambda tf, most, mean: 1 + F.log(tf),
    "a": lambda tf, most, mean: 0.5 + 0.5 * tf / most,
    "b": lambda tf, most, mean: F.lit(1.0),
    "L": lambda tf, most, mean: (1 + F.log(tf)) / (1 + F.log(mean)),
}
IDF = {
    "n": lambda n, df: F.lit(1.0),
    "t": lambda n, df: F.log(n / df),
    "p": lambda n, df: F.greatest(F.lit(0.0), F.log(F.nullif(n - df, F.lit(0.0)) / df)),
    "b": lambda n, df: F.log1p((n - df + 0.5) / (df + 0.5)),
}
NORM = {
    "n": lambda s, term: F.lit(1.0),
    "c": lambda s, term: F.sqrt(F.sum(s * s)),
    "b": lambda s, term: F.sum(F.greatest(F.lit(1.0), s) * F.length(term)),
}


@dataclass(frozen=True)
class WeightSpec:
    """A scheme and the constants of the saturation; ``saturate`` is for the plain scheme."""

    mode: str = "ltc"
    k: float = 1.2
    b: float = 0.5
    delta: float = 0.5
    saturate: bool = True

    def __post_init__(self):
        if len(self.mode) != 3 or self.mode[0] not in TF or self.mode[1] not in IDF or self.mode[2] not in NORM:
            raise ValueError(f"unknown weighting scheme {self.mode!r}")

    def tf(self, tf: Column, most: Column, mean: Column, dl: Column, mean_dl: Column) -> Column:
        x = TF[self.mode[0]](tf.cast("double"), most.cast("double"), mean)
        return bm25(x, dl, mean_dl, self.k, self.b, self.delta) if self.saturate else x

    def idf(self, n: Column, df: Column) -> Column:
        """0 for a term that no document has."""
        n, df = n.cast("double"), F.coalesce(df, F.lit(0)).cast("double")
        return F.when(df > 0, IDF[self.mode[1]](n, F.nullif(df, F.lit(0.0)))).otherwise(0.0)

    def norm(self, score: Column, term: Column, by: str) -> Column:
        """What scores are divided by, over the rows of a document; null where it is 0."""
        if self.mode[2] == "n":
            return F.lit(1.0)
        return self.norm_of(F.sum(self.norm_part(score, term)).over(Window.partitionBy(by)))

    def norm_part(self, score: Column, term: Column) -> Column:
        """What a row adds to the sum that the norm is made of."""
        return score * score if self.mode[2] == "c" else F.greatest(F.lit(1.0), score) * F.length(term)

    def norm_of(self, whole: Column) -> Column:
        """The norm by the sum over all rows of a document."""
        return F.nullif(F.sqrt(whole) if self.mode[2] == "c" else whole, F.lit(0.0))


def bm25(x: Column, dl: Column, mean_dl: Column, k: float = 1.2, b: float = 0.5, delta: float = 0.5) -> Column:
    return x * (k + 1) / (x + k * (1 - b + b * dl / mean_dl)) + delta


def true_tf_idf(freq: Column, n: Column, df: Column, boost: Column) -> Column:
    return freq * ((n - df) / df) * boost


def true_bm25_idf(n: Column, df: Column) -> Column:
    return (n - df).cast("double") / df


#: by name: the score of a term of frequency f in a document of length dl, where df of n documents have it
SIMILARITIES = {
    "BM25": lambda f, dl, mean_dl, n, df, boost: boost * F.log1p((n - df + 0.5) / (df + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * dl / mean_dl)),
    "TFIDF": lambda f, dl, mean_dl, n, df, boost: boost * F.sqrt(f) * F.pow(F.log((n + 1.0) / (df + 1.0)) + 1.0, F.lit(2.0)) / F.sqrt(dl),
    "trueBM25": lambda f, dl, mean_dl, n, df, boost: boost * true_bm25_idf(n, df) * f / (f + 1.2 * (0.25 + 0.75 * dl / mean_dl)),
    "trueTFIDF": lambda f, dl, mean_dl, n, df, boost: true_tf_idf(f, n, df, boost),
}


def similarity(name: str = "BM25"):
    """The similarity of this name, BM25 for an unknown one; lengths are taken as they are, not cut to a byte."""
    return SIMILARITIES.get(name, SIMILARITIES["BM25"])
