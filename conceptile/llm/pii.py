"""Personal data: patterns for what is personal by itself, and information-theoretic sanitisation for what reveals it.

First every text is scanned for e-mail addresses, IP addresses, cards and phone numbers (the base spans). The values found are
the protected entities. How strongly a term t reveals an entity e is estimated from the whole corpus as the part of the
information content of e that it discloses:

    PMI(e; t) / IC(e),   PMI = log(N c(e,t) / (c(e) c(t))),   IC = log(N / c(e))

with counts c over the N different texts, so that copies count once. In a document whose entity e is masked, a term that
discloses ``remove_at`` of it or more would give it back, and is removed; from ``generalise_at`` on it is generalised. Entities
and pairs of every count take part, those of one text too: most personal data is that rare.

Entities that are in the same texts are one group, as each of them is disclosed alike; a document has at most as many pairs as
terms and groups. Only documents with base spans are shuffled, unless the hashes of texts that have copies exceed what Spark
broadcasts; a document's text is read twice, once for base spans and once to count the candidate terms over all texts. A pair of a group and a term is a summed count, so an entity in a third of all documents is no hot group.

Defined cases: a null or empty text has no spans; rows that repeat a document are scanned and counted each; other columns are
not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, LONG, STRING, Scratch, batches_of, column, schema, signed, table

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
GENERALISE_AT, REMOVE_AT = 0.6, 0.9
BLOCK, SIEVE = 1 << 18, 1 << 27  # terms whose sums a task holds; bits that say which terms are counted
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[^\W_]{3,}|[^\W_]?[^\W_a-z][^\W_]?")
CHAIN = re.compile(r"[^\W_]+(?:[-_./:][^\W_]+)*")
DIGIT = re.compile(r"\d")
Span = tuple[int, str, int]  # start, kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their @ signs so that no run of characters is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers: every fourth of a chain, whatever its length."""
    for m in NUMBERS.finditer(text) if "." in text else ():
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    yield at, at + size
                at += size + 1


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = [(a, "email", b) for a, b in emails(text)] + [(a, "ip", b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def parsed(spans: str) -> list[Span]:
    return [(int(a), kind, int(b)) for kind, a, b in (x.split(":") for x in spans.split(",") if x)]


def entity(text: str, span: Span) -> str:
    """What identifies the value: its letters and digits, whatever separates them."""
    value = text[span[0] : span[2]].lower()
    return f"{span[1]}:{value if span[1] in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def h64(x: str) -> int:
    n = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


def in_chain(chain: str) -> list[str]:
    """The terms of runs joined by single signs: all of it as one if it has a digit (a date, an identifier), else its runs."""
    return [chain] if DIGIT.search(chain) else RUN.findall(chain)


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Lower-cased terms that no base span touches: chains with digits, and runs of three letters or more, or of one or two that
    are not just a to z (capitals, other scripts)."""
    i = 0
    for m in CHAIN.finditer(text):
        while i < len(spans) and spans[i][2] <= m.start():
            i += 1
        free = i == len(spans) or m.end() <= spans[i][0]
        j = i
        for r in [m] if free and DIGIT.search(m[0]) else RUN.finditer(text, *m.span()):
            while j < len(spans) and spans[j][2] <= r.start():
                j += 1
            if j == len(spans) or r.end() <= spans[j][0]:
                yield r[0].lower(), r.start(), r.end()


def distinct_terms(text: str | None) -> set[str]:
    """The terms of a text outside its base spans."""
    if not text:
        return set()
    if spans := base_spans(text):
        return {w for w, _, _ in terms(text, spans)}
    return {w.lower() for chain in set(CHAIN.findall(text)) for w in in_chain(chain)}


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, counts by kind, base_sha256 and spans; for documents with spans also text, its hash and its entities' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "text", "text_hash", "entities")}
            for t in column(batch, "text"):
                spans = base_spans(t) if t else []
                for k in KINDS[:4]:
                    out[f"n_{k}"].append(sum(s[1] == k for s in spans))
                out["spans"].append(s := joined(spans))
                out["base_sha256"].append(hashlib.sha256(s.encode()).hexdigest())
                out["text"].append(t if spans else None)
                out["text_hash"].append(h64(t) if spans else None)
                out["entities"].append(sorted({h64(entity(t, s)) for s in spans}) if spans else None)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["row", "doc_id", *out])

    fields = schema(row=LONG, doc_id=LONG, n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, base_sha256=STRING, spans=STRING, text=STRING, text_hash=LONG, entities=T.ArrayType(LONG))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, fields)


def term_rows(personal: DataFrame) -> DataFrame:
    """(text_hash, terms): the distinct terms of each different text with base spans, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = [sorted({h64(w) for w, _, _ in terms(t, parsed(s))}) for t, s in zip(column(batch, "text"), column(batch, "spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["text_hash", "terms"])

    return personal.select("text_hash", "text", "spans").mapInArrow(run, schema(text_hash=LONG, terms=T.ArrayType(LONG))).dropDuplicates(["text_hash"])


def copies_of(docs: DataFrame) -> DataFrame:
    """(_copy, n): the hash of each text that several documents have, and how many."""
    return docs.groupBy(F.xxhash64("text").alias("_copy")).agg(F.count("*").alias("n")).where("n > 1")


def sieve(wanted: DataFrame) -> np.ndarray:
    """A bit for the hash of each wanted term, SIEVE bits in all whatever their number."""
    bit = F.pmod("term", F.lit(SIEVE)) + 1
    out = np.zeros(SIEVE // 8, dtype=np.uint8)
    size = 4096  # bytes of Spark's bitmaps
    for r in wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator():
        out[(r.k - 1) * size : r.k * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def document_counts(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, c): in how many different texts each wanted term is. One pass, however many terms are wanted: a sieve of fixed size
    says which terms of a text may be, tasks sum what passes and send it on whenever BLOCK terms have come together, and the
    sums are joined with the wanted ones. A copy counts as its part of the text."""
    copies = scratch.keep(copies_of(docs), "copies")
    texts = docs.select("text", F.xxhash64("text").alias("_text")).join(copies, F.col("_text") == F.col("_copy"), "left").select("text", (1 / F.coalesce("n", F.lit(1))).alias("part"))
    sent, most = docs.sparkSession.sparkContext.broadcast(sieve(wanted)), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, sums = sent.value, {}, defaultdict(float)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], ["term", "c"])

        for batch in batches_of(batches):
            for t, part in zip(column(batch, "text"), column(batch, "part"), strict=True):
                own = distinct_terms(t)
                if len(known) > 1 << 19:
                    known.clear()
                for w in own.difference(known):
                    h = h64(w)
                    i = h % SIEVE
                    known[w] = h if bits[i >> 3] >> (i & 7) & 1 else None
                for h in {known[w] for w in own}:
                    if h is not None:
                        sums[h] += part
            if len(sums) >= most:
                yield rows()
                sums.clear()
        yield rows()

    found = texts.mapInArrow(run, schema(term=LONG, c=DOUBLE)).groupBy("term").agg(F.round(F.sum("c")).cast("long").alias("c"))
    return scratch.keep(found.join(wanted.select("term").distinct(), "term", "left_semi"), "term-counts")


def disclosures(docs: DataFrame, personal: DataFrame, scratch: Scratch, generalise_at: float) -> DataFrame:
    """(text_hash, term, share): the terms that reveal an entity of their own text, and how much of it."""
    pairs = scratch.keep(personal.select("text_hash", F.explode("entities").alias("entity")).distinct(), "entities")
    # entities of the same texts: as many, with the same sum
    alike = scratch.keep(pairs.groupBy("entity").agg(F.count("*").alias("c_e"), F.bit_xor(F.xxhash64("text_hash")).alias("texts")), "alike")
    groups = pairs.join(alike, "entity").select("text_hash", F.xxhash64("texts", "c_e").alias("entity"), "c_e").distinct()
    n = docs.count() - (copies_of(docs).agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    groups = groups.where(F.col("c_e") < n)
    held = scratch.keep(groups.join(term_rows(personal), "text_hash").select("text_hash", "entity", "c_e", F.explode("terms").alias("term")), "entity-terms")
    share = lambda c_t: F.log(F.lit(float(n)) * F.col("c_et") / (F.col("c_e") * c_t)) / F.log(F.lit(float(n)) / F.col("c_e"))
    several = held.where("c_e > 1").groupBy("entity", "term").agg(F.count("*").alias("c_et"), F.first("c_e").alias("c_e"))
    # a term is in c_et texts at least: pairs that fail with that fail with any count
    several = scratch.keep(several.where(share(F.col("c_et")) >= generalise_at), "candidates")
    single = held.where("c_e = 1").withColumn("c_et", F.lit(1).cast("long"))
    counts = document_counts(docs, scratch.keep(several.select("term").unionByName(single.select("term")).distinct(), "candidate-terms"), scratch)
    strong = lambda df, counts=counts: df.join(counts, "term").withColumn("share", share(F.greatest("c", "c_et"))).where(F.col("share") >= generalise_at)
    of_several = held.join(strong(several).select("entity", "term", "share"), ["entity", "term"]).select("text_hash", "term", "share")
    rare = counts.where(F.log(F.lit(float(n)) / F.greatest("c", F.lit(1))) >= generalise_at * float(np.log(max(n, 1))) - 1e-9)
    return strong(single, rare).select("text_hash", "term", "share").unionByName(of_several).groupBy("text_hash", "term").agg(F.max("share").alias("share"))


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, where there are spans, the sanitised text."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(scanned(docs), "personal")
    personal = found.where("text is not null")
    revealing = disclosures(docs, personal, scratch, generalise_at)
    # a text's own terms: as many as it has, and no more
    by_text = revealing.groupBy("text_hash").agg(F.collect_list(F.struct("term", (F.col("share") >= remove_at).alias("remove"))).alias("reveals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            spans, texts = [], []
            for t, s, reveals in zip(column(batch, "text"), column(batch, "spans"), column(batch, "reveals"), strict=True):
                own = parsed(s)
                if reveals:
                    how = {r["term"]: KINDS[5] if r["remove"] else KINDS[4] for r in reveals}
                    own += [(a, how[h], b) for w, a, b in terms(t, own) if (h := h64(w)) in how]
                    own.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                spans.append(joined(own))
                texts.append(masked(t, own) if own else None)
            rest = [batch.column(i) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised"])

    head = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    out = schema(**dict.fromkeys(head[:5], LONG), base_sha256=STRING, spans=STRING, sanitised=STRING)
    clean = found.where("text is null").select(*head, "spans", F.lit(None).cast("string").alias("sanitised"))
    return clean.unionByName(personal.join(by_text, "text_hash", "left").select(*head, "spans", "text", "reveals").mapInArrow(run, out))


def masked(text: str, spans: list[Span]) -> str:
    """The text with base spans named by kind, generalised terms by <TERM>, and removed terms gone; overlaps are masked once."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], {"generalise": "<TERM>", "remove": ""}.get(kind, f"<{kind.upper()}>")]
        done = max(done, b)
    return "".join(out) + text[done:]


def op2_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("sanitised")
