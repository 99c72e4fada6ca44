"""Exact token counts by overlap resynchronisation.

A text is cut into pieces that its tokenizer encodes one by one: added special tokens, and the pre-tokens between them. Where
the next piece starts decides everything to its right, so two encodings that have a piece boundary in common agree from there
on. Huge documents are therefore encoded in overlapping chunks with offsets, and spliced at a boundary both chunks have. What
stands near the end of a chunk is not proven, for a piece there may go on in the text: the last piece and ``MARGIN`` characters
(more than the longest special token) are never spliced at. Without a common boundary the overlap is widened, up to the rest
of the document, so that the count is exact always.

Pieces repeat, so that their counts are kept in a bounded table in each worker; what isn't in it is asked of the library. Cutting
with the vocabulary's own pattern is done here only for characters on which the engines cannot differ (``PLAIN``); other texts
are cut by the library itself.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; no other column is read but doc_id.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BOOL, LONG, batches_of, column, schema, table

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, MARGIN, LIMIT = 1 << 15, 256, 64, 1024
KEPT_PIECES, CHECKED = 1 << 18, 256  # one new piece of so many is asked of the library too
#: fixed value: the pattern of the byte-level vocabulary's pre-tokenizer, for the characters of PLAIN, the most frequent case first
PATTERN = r""" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Printable ASCII, its white space, letters and signs of Latin-1 and Latin Extended-A, general punctuation without white space
#: or controls; no numbers but 0-9.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*+")

Pieces = tuple[list[int], list[int]]  # where each piece ends, and its tokens


class Encoder:
    """Cuts texts into pieces with token counts, as the library encodes them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        if any(len(x) > MARGIN for x in added):
            raise ValueError("a special token is longer than the margin")
        self.added = added
        special = "|".join(map(re.escape, added))
        self.cut = re.compile(PATTERN)
        self.special = re.compile(f"({special})") if special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.asked = 0
        order = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level vocabularies write as they are
        self.bytes = str.maketrans({chr(b): chr(b) for b in order} | {chr(b): chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in order)})

    def of(self, piece: str) -> int:
        if piece in self.added:
            return 1
        return len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes)))

    def split(self, text: str) -> list[str]:
        if self.special is None or not any(x in text for x in self.added):
            return self.cut.findall(text)
        parts = self.special.split(text)  # odd places hold the special tokens
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.cut.findall(part))]

    def counts(self, pieces: list[str]) -> Iterator[int]:
        known = self.known
        for p in set(pieces).difference(known):
            n = self.older.get(p)
            known[p] = self.of(p) if n is None else n
            self.asked += 1
            if self.asked % CHECKED == 1 and p not in self.added and len(self.tokenizer.encode(p, add_special_tokens=False).ids) != known[p]:
                raise ValueError(f"the library counts other tokens in {p!r}")
        if len(known) > KEPT_PIECES:  # what was used lately is found again in the older half
            self.known, self.older = {}, known
        return map(known.__getitem__, pieces)

    def pieces(self, text: str) -> Pieces:
        if PLAIN.fullmatch(text):
            cut = self.split(text)
            ends, at = [], 0
            for p in cut:
                at += len(p)
                ends.append(at)
            return ends, list(self.counts(cut))
        e = self.tokenizer.encode(text, add_special_tokens=False)
        ends, counts, last = [], [], None
        for (_, end), word in zip(e.offsets, e.word_ids, strict=True):
            if word is None or word != last or not ends:
                ends.append(end)
                counts.append(1)
            else:
                ends[-1] = end
                counts[-1] += 1
            last = word
        return ends, counts

    def total(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return sum(self.counts(self.split(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def resync_count(text: str, pieces: Callable[[str], Pieces], chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of the whole text, of which no more than a chunk and its overlap are encoded at a time, unless pieces are longer: what
    has no proven boundary is encoded again with twice as much after it, so that a piece of any length costs a few times its size."""
    total, start, end, step = 0, 0, min(len(text), chunk), chunk
    ends, counts = pieces(text[:end])
    while end < len(text):
        # boundaries of this chunk that the text after it cannot move
        proven = max(0, min(end - start - margin, ends[-2] if len(ends) > 1 else 0))
        safe = bisect_left(ends, proven + 1)
        last, width = ends[safe - 1] if safe else 0, overlap
        while True:
            begin = max(start, start + last - width)  # an overlap without a boundary of ours can't have a common one
            stop = min(len(text), end + step)
            next_ends, next_counts = pieces(text[begin:stop])
            ours = {e: i for i, e in enumerate(ends[:safe])}
            common = next((i for i, e in enumerate(next_ends[:-1]) if e + begin - start in ours), None)
            if common is not None:
                total += sum(counts[: ours[next_ends[common] + begin - start] + 1])
                start, ends, counts = begin + next_ends[common], [e - next_ends[common] for e in next_ends[common + 1 :]], next_counts[common + 1 :]
                end, step = stop, chunk
                break
            if begin == start:  # nothing of this chunk is proven
                ends, counts, end, step = next_ends, next_counts, stop, 2 * step
                break
            width *= 4
    return total + sum(counts)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. One pass, no shuffle; ``path`` holds the vocabulary and is opened on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(path or public_tokenizers.path(VOCABULARY))
        for batch in batches_of(batches):
            texts = [t or "" for t in column(batch, "text")]
            tokens = [encoder.total(t) if len(t) <= CHUNK else resync_count(t, encoder.pieces) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, schema(doc_id=LONG, n_bytes=LONG, n_tokens=LONG, over_limit=BOOL))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
