"""Tokens of wiki markup with their types and places, as an expression over texts (Arrow batches).

One pass reads the markup and the words: a word has the type of the construct it stands in, the outermost one that has a type.

type            construct                                    tokens
word            anything else                                its words
link            [[target]], [[target|label]]                 words of both; nested links belong to the outer one
category        [[Category:name|key]]                        words after the colon
url             http://..., also that of an external link    the address as one token
external_link   [http://... label]                           words of the label
citation        <ref ...>...</ref>                           words, addresses too; <ref .../> has none
heading         == title == on a line of its own             words

Constructs that are not closed are text. Everything is found in time linear in the text: what closes a construct is looked for once.
``whole`` types come as one token each, their inside, instead of words. Places count characters, the end exclusive. A null text has no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD, LINK, CATEGORY, URL, EXTERNAL, CITATION, HEADING = TYPES = ("word", "link", "category", "url", "external_link", "citation", "heading")
#: what the wiki analyzer leaves out
STOPPED = (URL, EXTERNAL, CITATION)
TOKEN = T.StructType([T.StructField("term", T.StringType()), T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ADDRESS = r"https?://[^\s\]]+"
_ANY = re.compile(rf"(?im)(?P<open>\[\[)|(?P<ext>\[(?=\b{_ADDRESS}))|\b(?P<url>{_ADDRESS})|(?P<ref><ref\b)|(?P<head>^(?P<level>={{2,6}})(?!=)(?P<title>.*?)(?P=level)[ \t]*$)|(?P<word>WORD)")
_BRACKETS = re.compile(r"\[\[|\]\]")
_CATEGORY = re.compile(r"(?i)\s*category:")
_CLOSE = re.compile(r"(?i)</ref\s*>")

Token = tuple[str, str, int, int]


class Ahead:
    """The next place of a pattern from some place on; places must not fall."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.at, self.found = pattern, text, -1, None

    def __call__(self, i: int) -> re.Match | None:
        if self.at < 0 or (self.found and self.found.start() < i):
            self.found = self.pattern.search(self.text, i)
            self.at = i
        return self.found


def closed(text: str) -> dict[int, int]:
    """Where each [[ that is closed ends, inner ones too."""
    opened, out = [], {}
    for m in _BRACKETS.finditer(text):
        if m[0] == "[[":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def patterns(word: str) -> tuple[re.Pattern, re.Pattern]:
    """Of the constructs, and of words alone; ``word`` is written for Java, with classes of letters and numbers."""
    word = word.replace(r"[\p{L}\p{N}]", r"[^\W_]")
    return re.compile(_ANY.pattern.replace("WORD", word)), re.compile(word)


def tokens(text: str | None, word: str = r"[\p{L}\p{N}]+", whole: Iterable[str] = ()) -> Iterator[Token]:
    if not text:
        return
    anything, words = patterns(word)
    whole = frozenset(whole)
    ends = closed(text)
    bracket, ref_end, tag_end, line = (Ahead(re.compile(p) if isinstance(p, str) else p, text) for p in (r"\]", _CLOSE, ">", r"\n"))

    def inside(kind: str, start: int, end: int) -> Iterator[Token]:
        if kind in whole:
            if start < end:
                yield text[start:end], kind, start, end
            return
        for m in words.finditer(text, start, end):
            yield m[0], kind, m.start(), m.end()

    i = 0
    while m := anything.search(text, i):
        kind, at = m.lastgroup, m.start()
        i = m.end()
        if m["word"] is not None:
            yield m[0], WORD, at, i
        elif m["url"] is not None:
            yield m[0], URL, at, i
        elif m["head"] is not None:
            yield from inside(HEADING, m.start("title"), m.end("title"))
        elif m["open"] is not None:
            i = ends.get(at, at + 1)
            if at in ends:
                name = _CATEGORY.match(text, at + 2, i - 2)
                yield from inside(CATEGORY if name else LINK, name.end() if name else at + 2, i - 2)
        elif m["ext"] is not None:
            stop, newline = bracket(i), line(i)
            if stop and not (newline and newline.start() < stop.start()):
                address = re.compile(_ADDRESS).match(text, i, stop.start())
                yield address[0], URL, address.start(), address.end()
                yield from inside(EXTERNAL, address.end(), stop.start())
                i = stop.end()
        elif m["ref"] is not None:
            tag, i = tag_end(i), at + 1
            if tag and text[tag.start() - 1] == "/":
                i = tag.end()
            elif tag and (stop := ref_end(tag.end())):
                yield from inside(CITATION, tag.end(), stop.start())
                i = stop.end()


def lexed(text: Column, word: str = r"[\p{L}\p{N}]+", whole: Iterable[str] = ()) -> Column:
    """array<struct<term, type, start, end>> of each text, in order."""
    whole = tuple(whole)
    kind = pa.list_(pa.struct([("term", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        flat, offsets = ([], [], [], []), [0]
        for t in texts.to_pylist():
            for token in tokens(t, word, whole):
                for x, v in zip(flat, token, strict=True):
                    x.append(v)
            offsets.append(len(flat[0]))
        cells = [pa.array(x, f.type) for x, f in zip(flat, kind.value_type, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, fields=list(kind.value_type)))

    return F.arrow_udf(run, returnType=T.ArrayType(TOKEN))(text)


def without_types(found: Column, types: Iterable[str] = STOPPED) -> Column:
    """The tokens of other types."""
    types = list(types)
    return F.filter(found, lambda x: ~x["type"].isin(types)) if types else found


def of_types(found: Column, types: Iterable[str]) -> Column:
    types = list(types)
    return F.filter(found, lambda x: x["type"].isin(types))


def terms(found: Column, each: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.transform(found, lambda x: each(x["term"]))


def link_analyzer(text: Column) -> Column:
    """Internal links as whole tokens among the words, without external links and citations."""
    return terms(without_types(lexed(text, whole=(LINK,))))
