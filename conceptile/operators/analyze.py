"""From texts to terms: the analyzer chain over arrays of tokens, and counts of terms without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer as L
from ..functions import text as T
from .staging import spread


@dataclass(frozen=True)
class AnalyzerSpec:
    """What the chain does, in its fixed order: preprocess, tokenise, drop types (by the lexer of markup, if there are any), fold,
    lower, classic, singular, length, dictionary, stop words, stem. Word lists of this size go into the plan; lists that grow with the data are joined, see
    ``without_terms`` and ``only_terms``."""

    preprocess: tuple[str, ...] = ()
    pattern: str = T.TOKEN
    drop_types: tuple[str, ...] = ()
    ascii: bool = False
    lower: bool = True
    classic: bool = False
    singular: bool = False
    min_length: int = 0
    max_length: int = 1000
    dictionary: frozenset[str] = field(default_factory=frozenset)
    stop_words: frozenset[str] = field(default_factory=frozenset)

    def tokens(self, text: Column) -> Column:
        text = T.preprocessor(self.preprocess)(F.coalesce(text, F.lit("")))
        each = []
        if self.ascii:
            each.append(T.folded)
        if self.lower:
            each.append(F.lower)
        if self.drop_types:  # tokens are folded, not the text, as the lexer reads markup as it is
            out = L.terms(L.without_types(L.lexed(text, self.pattern), self.drop_types))
        else:
            for f in each:
                text = f(text)
            out, each = T.tokens(text, self.pattern), []
        if self.classic:
            each.append(T.classic)
        if self.singular:
            each.append(T.singular)
        for f in each:
            out = F.transform(out, f)
        if self.min_length > 0:
            out = F.filter(out, lambda x: F.length(x).between(self.min_length, self.max_length))
        if self.dictionary:
            out = F.filter(out, lambda x: F.lower(x).isin([w.lower() for w in sorted(self.dictionary)]))
        if self.stop_words:
            out = F.filter(out, lambda x: ~F.lower(x).isin([w.lower() for w in sorted(self.stop_words)]))
        return out


DEFAULT = AnalyzerSpec()


def once(c: Column) -> Column:
    """The same column, computed once a row: what isn't deterministic is neither copied into the filters that are pushed below it
    nor into the lambdas that use it, where it would be computed for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def token_rows(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term): every token in order."""
    return spread(docs.select(key, text)).select(F.col(key), F.posexplode(spec.tokens(F.col(text))).alias("pos", "term"))


def counted(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms: array<struct<term, tf>>, dl): counts by runs of the sorted tokens, in the document's own row."""
    df = spread(docs.select(key, text)).select(F.col(key), once(F.sort_array(spec.tokens(F.col(text)))).alias("_t"))
    t, n = F.col("_t"), F.size("_t")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (t[i] != t[F.greatest(i - 1, F.lit(0))]))
    df = df.withColumn("_s", once(F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))))
    ends = F.concat(F.slice("_s", F.lit(2), F.size("_s")), F.array(n))
    runs = F.zip_with(F.col("_s"), ends, lambda a, b: F.struct(t[a].alias("term"), (b - a).cast("long").alias("tf")))
    return df.select(key, once(F.when(n > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))).alias("terms"), n.cast("long").alias("dl"))


def packed_counts(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms: array<struct<term, tf>>, dl, max_tf, avg_tf): a row for each document."""
    most = F.array_max(F.transform("terms", lambda x: x["tf"]))
    mean = F.col("dl") / F.nullif(F.size("terms"), F.lit(0))
    return counted(docs, spec, key, text).select(key, "terms", "dl", once(most).alias("max_tf"), once(mean).alias("avg_tf"))  # before a row becomes many


def unpacked_counts(packed: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, term, tf, dl, max_tf, avg_tf, more) of packed counts."""
    return packed.select(key, F.explode("terms").alias("x"), "dl", "max_tf", "avg_tf", *more).select(key, "x.term", "x.tf", "dl", "max_tf", "avg_tf", *more)


def term_counts(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl, max_tf, avg_tf) without a shuffle: terms of one document never leave its task."""
    return unpacked_counts(packed_counts(docs, spec, key, text), key)


def restated(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same columns after terms were dropped or renamed: counts, lengths and means anew."""
    tf = counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    per = tf.groupBy(key).agg(F.sum("tf").alias("dl"), F.max("tf").alias("max_tf"), F.avg("tf").alias("avg_tf"))
    return tf.join(per, key).select(key, "term", "tf", "dl", "max_tf", "avg_tf")


def without_terms(counts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    return restated(counts.join(terms.select("term"), "term", "left_anti"), key)


def only_terms(counts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    return restated(counts.join(terms.select("term").distinct(), "term", "left_semi"), key)


def lemmatised(counts: DataFrame, lemmas: DataFrame, keep: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Terms as the lemmas that a table (term, lemma, pos) gives them, if their part of speech starts with one of ``keep`` (none:
    any); terms that it doesn't know stay. A term with several rows takes the least lemma."""
    if keep:
        known = F.lit(False)
        for k in keep:
            known = known | F.col("pos").startswith(k)
        lemmas = lemmas.where(known)
    forms = lemmas.groupBy("term").agg(F.min("lemma").alias("lemma"))
    named = counts.join(forms, "term", "left").select(key, F.coalesce("lemma", "term").alias("term"), "tf")
    return restated(named, key)


def stemmed(counts: DataFrame, depth: int = 1, key: str = "doc_id") -> DataFrame:
    """Porter stems, applied so many times; each distinct term is stemmed once and joined back."""
    from ..functions.porter import stems

    forms = counts.select("term").distinct().select("term", stems(depth)("term").alias("stem"))
    return restated(counts.join(forms, "term").select(key, F.col("stem").alias("term"), "tf"), key)


def dumped_tokens(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the tokens of each text in order, joined by spaces, as a look at what the chain leaves."""
    return docs.select(F.col(key), F.array_join(spec.tokens(F.col(text)), " ").alias("tokens"))
