"""Templates of wiki markup: references, their parameters, and expansion.

Expansion needs the templates that it meets in hand. They are sent to the executors, which is why ``reachable`` cuts a table down
to those that the pages can reach within the depth, and ``TemplateTable`` refuses what takes more than ``LIMIT`` bytes even so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: fixed values: names that no template has, by their beginnings; those that format and swallow their pipes; those of titles
MAGIC_STARTS = (
    "__TOC__",
    "__FORCETOC__",
    "__NOTOC__",
    "__NOEDITSECTION__",
    "__NEWSECTIONLINK__",
    "__NONEWSECTIONLINK__",
    "__NOGALLERY__",
    "__HIDDENCAT__",
    "__INDEX__",
    "__NOINDEX__",
    "__STATICREDIRECT__",
    "__DISAMBIG__",
    "DISPLAYTITLE",
    "DEFAULTSORT",
    "NOEXTERNALLANGLINKS",
    "SUBPAGENAME",
    "ARTICLEPAGENAME",
    "SUBJECTPAGENAME",
    "TALKPAGENAME",
    "NAMESPACENUMBER",
    "NAMESPACE",
    "ARTICLESPACE",
    "SUBJECTSPACE",
    "TALKSPACE",
    "SUBPAGENAMEE",
    "ARTICLEPAGENAMEE",
    "SUBJECTPAGENAMEE",
    "TALKPAGENAMEE",
    "SHORTDESC",
    "SITENAME",
    "SERVER",
    "SERVERNAME",
    "SCRIPTPATH",
    "CURRENTVERSION",
    "CURRENTYEAR",
    "CURRENTMONTH",
    "CURRENTMONTHNAME",
    "CURRENTMONTHABBREV",
    "CURRENTDAY",
    "CURRENTDAY2",
    "CURRENTDOW",
    "CURRENTDAYNAME",
    "CURRENTTIME",
    "CURRENTHOUR",
    "CURRENTWEEK",
    "CURRENTTIMESTAMP",
    "REVISIONDAY",
    "REVISIONDAY2",
    "REVISIONMONTH",
    "REVISIONYEAR",
    "REVISIONTIMESTAMP",
    "REVISIONUSER",
    "NUMBEROFPAGES",
    "NUMBEROFARTICLES",
    "NUMBEROFFILES",
    "NUMBEROFEDITS",
    "NUMBEROFUSERS",
    "NUMBEROFADMINS",
    "NUMBEROFACTIVEUSERS",
    "PAGEID",
    "PAGESIZE",
    "PROTECTIONLEVEL",
    "PROTECTIONEXPIRY",
    "PENDINGCHANGELEVEL",
    "PAGESINCATEGORY",
    "NUMBERINGROUP",
    "formatnum",
    "padleft",
    "padright",
    "plural",
    "gender",
    "localurl",
    "fullurl",
    "canonicalurl",
    "filepath",
    "urlencode",
    "anchorencode",
    "ns",
    "int",
)
FORMATS = ("lc:", "uc:", "lcfirst:", "ucfirst:")
TITLES = ("FULLPAGENAME", "PAGENAME", "BASEPAGENAME", "ROOTPAGENAME")
_VARIABLE = re.compile(r"\{\{\{([^|}]+)(?:\|([^}]*))?\}\}\}")
_SIGN = re.compile(r"[{}\[\]|=:]")
LIMIT, DEPTH = 256 << 20, 5


@dataclass(frozen=True)
class Reference:
    name: str
    text: str
    parameters: list[tuple[int, str, str]] = field(default_factory=list)  # index from 1, name, value

    @property
    def is_title(self) -> bool:
        return self.name.startswith(TITLES)

    @property
    def is_tag(self) -> bool:
        return self.name.startswith("#tag")

    @property
    def is_format(self) -> bool:
        return self.name.startswith(FORMATS)

    @property
    def is_magic(self) -> bool:
        return self.name[0] == "#" and not self.is_tag


def valid_name(name: str) -> bool:
    return bool(name) and name[0] not in "{}[]<>|" and not name.startswith(MAGIC_STARTS)


def _read(text: str, start: int) -> tuple[int, Reference | None]:
    """The reference whose braces open at ``start``: where it ends (-1 if nowhere), and what it is."""
    level, square, cuts, swallow = 2, 0, [], False
    for m in _SIGN.finditer(text, start + 2):
        sign, at = m[0], m.start()
        if sign in "{}":
            level += 1 if sign == "{" else -1
            if level == 0:
                return at + 1, _made(text, start, at + 1, cuts)
        elif sign in "[]":
            square += 1 if sign == "[" else -1
            if abs(square) == 2:
                level += square // 2
                square = 0
        elif level == 2 and not swallow:
            if sign == ":":
                swallow = not cuts and text.startswith((*FORMATS, "#tag:"), start + 2)
            elif sign == "|" or cuts:
                cuts.append((sign, at))
    return -1, None


def _made(text: str, start: int, end: int, cuts: list[tuple[str, int]]) -> Reference | None:
    """From the places of the pipes, and of the equal signs after the first of them."""
    stop = end - 2
    bounds = [at for _, at in cuts] + [stop]
    name = text[start + 2 : bounds[0]].strip()
    if not valid_name(name):
        return None
    parameters: list[tuple[int, str, str]] = []
    given: str | None = None
    for i, (sign, at) in enumerate(cuts):
        value = text[at + 1 : bounds[i + 1]]
        ends = i + 1 == len(cuts) or cuts[i + 1][0] == "|"
        if sign == "|":
            given = None
        if not ends:
            given = value
        elif value or i + 1 < len(cuts):
            n = len(parameters) + 1
            parameters.append((n, str(n), value) if given is None else (n, given.strip(), value.strip()))
    return Reference(name, text[start:end], parameters)


def references(text: str) -> Iterator[Reference]:
    """The outermost templates of a text. An opening without an end hides all after it."""
    at = text.find("{{")
    while 0 <= at < len(text) - 2:
        if text[at + 2] in "{}[]<>|":
            at = text.find("{{", at + 2)
            continue
        end, found = _read(text, at)
        if end < 0:
            return
        if found:
            yield found
        at = text.find("{{", end)


def normal_title(title: str) -> str:
    """The same as the expression of this name in functions.text, for one string."""
    out = title[:1].lower() + title[1:]
    head, colon, rest = out.partition(":")
    out = head + colon + rest[:1].lower() + rest[1:]
    return re.sub(r"\s+", " ", out.replace("_", " ").strip("".join(map(chr, range(33)))))


def _filled(body: str, parameters: list[tuple[int, str, str]]) -> str:
    """A template's body with its variables replaced; a variable that nothing gives stays."""
    given = {name: value for _, name, value in parameters}
    for m in list(_VARIABLE.finditer(body)):
        value = given.get(m[1], m[2])
        if value is not None:
            body = body.replace(m[0], "" if m[0] in value else value)
    return body


def expand(text: str, title: str, templates: Mapping[str, str], depth: int = DEPTH, most: int = 0, seen: frozenset[str] = frozenset(), level: int = 1) -> str:
    """The text with its templates expanded to so many levels; those already open, unknown, or beyond ``most`` in one body (0: no
    bound) leave their values."""
    if level > depth:
        return text
    done = 0
    for ref in references(text):
        name = normal_title(ref.name)
        if ref.is_title:
            text = text.replace(ref.text, title)
        elif ref.is_format or ref.is_tag:
            text = text.replace(ref.text, ref.name.partition(":" if ref.is_format else "|")[2])
        elif ref.is_magic:
            text = text.replace(ref.text, "")
        elif name in templates and name not in seen and not (level > 1 and 0 < most < done):
            body = expand(_filled(templates[name], ref.parameters), title, templates, depth, most, seen | {name}, level + 1)
            text = text.replace(ref.text, body, 1)
            done += 1
        else:
            text = text.replace(ref.text, "".join(f"{v} " for _, _, v in ref.parameters))
    return text


REFERENCE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("params", T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])))]))


def parsed_templates(text: Column) -> Column:
    """The references of a text as an array of structs."""

    @F.pandas_udf(REFERENCE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": r.name, "text": r.text, "params": [dict(zip(("index", "name", "value"), p, strict=True)) for p in r.parameters]} for r in references(t or "")])

    return run(text)


def template_bodies(pages: DataFrame, stripped: Column | None = None, min_terms: int = 0, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """(name, body) of the template pages (title, text) that are kept: ``stripped`` says which titles are not, and bodies of fewer
    than ``min_terms`` tokens are not either. Of several pages of one name the one with the least body counts."""
    from . import text as X

    kept = pages.where(F.col("title").startswith("Template:") & ~F.col("text").contains("#invoke"))
    if stripped is not None:
        kept = kept.where(~stripped)
    name = X.normalize_title(F.col("title").substr(F.lit(10), F.length("title")))
    bodies = kept.select(name.alias("name"), X.only_included(X.without_noinclude(F.col("text"))).alias("body")).where("name <> ''")
    if min_terms > 0:
        bodies = bodies.where(F.size((tokens or X.tokens)(F.col("body"))) >= min_terms)
    return bodies.groupBy("name").agg(F.min("body").alias("body"))


def template_names(text: Column) -> Column:
    """The distinct normalised names of the templates that a text refers to, at any depth of nesting."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def names(t: str) -> set[str]:
            out, todo = set(), [t]
            while todo:
                for r in references(todo.pop()):
                    out.add(normal_title(r.name))
                    todo += [v for _, _, v in r.parameters if "{{" in v]
            return out

        return texts.map(lambda t: sorted(names(t)) if t and "{{" in t else [])

    return run(text)


def reachable(bodies: DataFrame, texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The bodies (name, body) that the texts (text) name, and those that these name in turn, down to the depth of expansion."""
    from ..operators.staging import kept

    ship(bodies.sparkSession)
    rows = kept(bodies.select("name", "body", template_names(F.col("body")).alias("names")), "templates")
    found = front = kept(texts.select(F.explode(template_names(F.col("text"))).alias("name")).distinct(), "names")
    for _ in range(depth):
        step = rows.join(front, "name", "left_semi").select(F.explode("names").alias("name")).distinct()
        front = kept(step.join(found, "name", "left_anti"), "names")
        if front.isEmpty():
            break
        found = kept(found.unionByName(front), "names")
    return rows.join(found, "name", "left_semi").select("name", "body")


class TemplateTable:
    """Templates by name, expanded in themselves once, on the driver and on every executor."""

    def __init__(self, spark: SparkSession, bodies: DataFrame, depth: int = DEPTH, most: int = 0, limit: int = LIMIT):
        ship(spark)
        size = bodies.agg(F.sum(F.octet_length("name") + F.octet_length("body"))).first()[0] or 0
        if size > limit:
            raise ValueError(f"templates take {size} bytes, more than {limit}; keep only those that the pages use")
        raw = {r.name: r.body for r in bodies.orderBy("name").collect()}
        self.templates = {n: expand(b, n, raw, depth, most, frozenset([n]), 2) for n, b in raw.items()}
        self.depth, self.most = depth, most
        self.sent = spark.sparkContext.broadcast(self.templates)

    def expanded(self, text: Column, title: Column) -> Column:
        sent, depth, most = self.sent, self.depth, self.most

        @F.pandas_udf("string")
        def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else expand(t, n or "", sent.value, depth, most) for t, n in zip(texts, titles, strict=True)], dtype=object)

        return run(text, title)
