"""Types and places of tokens against a scanner that looks at one character at a time."""

import random
import re
import time

import pytest
from conceptile.functions import lexer as L
from conceptile.operators.analyze import AnalyzerSpec, dumped_tokens, term_counts
from pyspark.sql import functions as F


def scanned(text):
    """Slow and separate: every construct is tried at every place, and what closes it is looked for from there."""
    out, i, n = [], 0, len(text)

    def words(kind, a, b):
        j = a
        while j < b:
            k = j
            while k < b and text[k].isalnum():
                k += 1
            if k > j:
                out.append((text[j:k], kind, j, k))
            j = max(k, j + 1)

    def pair(a):
        """The end of the [[ at a: brackets are read in twos from the text's beginning."""
        open_, p = [], 0
        while p < n - 1:
            two = text[p : p + 2]
            if two == "[[":
                open_.append(p)
                p += 2
            elif two == "]]":
                if open_ and open_.pop() == a:
                    return p + 2
                p += 2
            else:
                p += 1
        return None

    def address(a):
        b = a
        while b < n and not text[b].isspace() and text[b] != "]":
            b += 1
        start = re.match("(?i)https?://", text[a:b])
        boundary = a == 0 or not (text[a - 1].isalnum() or text[a - 1] == "_")
        return b if start and boundary and b - a > len(start[0]) else None

    while i < n:
        c = text[i]
        if c == "=" and (i == 0 or text[i - 1] == "\n"):
            line = text[i : text.find("\n", i) if "\n" in text[i:] else n]
            level = len(line) - len(line.lstrip("="))
            core = line.rstrip(" \t")
            if 2 <= level <= 6 and len(core) >= 2 * level and core.endswith("=" * level):
                # the title ends at the first run of the level after which the line is blank
                stop = next(p for p in range(level, len(line)) if line[p : p + level] == "=" * level and not line[p + level :].strip(" \t"))
                words("heading", i + level, i + stop)
                i += len(line)
                continue
        if text.startswith("[[", i) and (end := pair(i)):
            head = re.match(r"(?i)\s*category:", text[i + 2 : end - 2])
            words("category" if head else "link", i + 2 + (head.end() if head else 0), end - 2)
            i = end
            continue
        if c == "[" and address(i + 1):
            stop, line = text.find("]", i), text.find("\n", i)
            if stop > 0 and not 0 <= line < stop:
                b = address(i + 1)
                out.append((text[i + 1 : b], "url", i + 1, b))
                words("external_link", b, stop)
                i = stop + 1
                continue
        if text[i : i + 4].lower() == "<ref" and not (i + 4 < n and (text[i + 4].isalnum() or text[i + 4] == "_")):
            tag = text.find(">", i + 4)
            if tag >= 0 and text[tag - 1] == "/":
                i = tag + 1
                continue
            close = re.search(r"(?i)</ref\s*>", text[tag + 1 :]) if tag >= 0 else None
            if close:
                words("citation", tag + 1, tag + 1 + close.start())
                i = tag + 1 + close.end()
                continue
            i += 1
            continue
        if (b := address(i)) is not None:
            out.append((text[i:b], "url", i, b))
            i = b
            continue
        if c.isalnum():
            b = i
            while b < n and text[b].isalnum():
                b += 1
            out.append((text[i:b], "word", i, b))
            i = b
            continue
        i += 1
    return out


KNOWN = "== A title ==\nSee [[Supplier|the one]] [http://x.org home of] https://y.org/a. <ref name='q'>cited b</ref><ref name=q/> [[Category: C d|k]] é1 [[open <ref>x"


def test_known_text():
    got = list(L.tokens(KNOWN))
    assert [(t, k) for t, k, _, _ in got] == [("A", "heading"), ("title", "heading"), ("See", "word"), ("Supplier", "link"), ("the", "link"), ("one", "link"), ("http://x.org", "url"), ("home", "external_link"), ("of", "external_link"), ("https://y.org/a.", "url"), ("cited", "citation"), ("b", "citation"), ("C", "category"), ("d", "category"), ("k", "category"), ("é1", "word"), ("open", "word"), ("ref", "word"), ("x", "word")]
    assert all(KNOWN[a:b] == t for t, _, a, b in got) and got == scanned(KNOWN)
    whole = list(L.tokens(KNOWN, whole=("link", "category")))
    assert ("Supplier|the one", "link") in [w[:2] for w in whole] and (" C d|k", "category") in [w[:2] for w in whole]


@pytest.mark.parametrize("seed", range(8))
def test_random_markup(seed):
    rng = random.Random(seed)
    bits = ["[[", "]]", "[", "]", "http://a.b/c", "https://", "x", "Word", "é", "_", " ", "\n", "== ", " ==", "===", "<ref", "<ref>", "</ref>", "</REF >", "/>", ">", "|", "Category:", "category :", ".", "'", "1"]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 25)))
        assert list(L.tokens(text)) == scanned(text), repr(text)


@pytest.mark.parametrize("bit", ["[[", "<ref ", "<ref>", "[http://a ", "== a\n", "==", "[[a]", "x[[", "<ref/", "]]", "[[a]] ", "http://"])
def test_open_constructs_take_linear_time(bit):
    text, began = bit * (400_000 // len(bit)), time.process_time()
    sum(1 for _ in L.tokens(text))
    assert time.process_time() - began < 8


def test_tokens_as_a_column(spark):
    df = spark.createDataFrame([(1, KNOWN), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.t for r in df.select("doc_id", L.lexed(F.col("text")).alias("t")).collect()}
    assert [tuple(x) for x in rows[1]] == scanned(KNOWN) and rows[2] == rows[3] == []
    links = df.select(L.link_analyzer(F.col("text")).alias("t")).first().t
    assert links[:4] == ["A", "title", "See", "Supplier|the one"] and "cited" not in links
    only = df.select(L.terms(L.of_types(L.lexed(F.col("text")), ["url"]), F.upper).alias("t")).first().t
    assert only == ["HTTP://X.ORG", "HTTPS://Y.ORG/A."]


def test_the_chain_drops_types(spark):
    df = spark.createDataFrame([(1, KNOWN), (2, None)], "doc_id long, text string")
    spec = AnalyzerSpec(drop_types=L.STOPPED, ascii=True)
    assert dumped_tokens(df, spec).first().tokens == "a title see supplier the one c d k e1 open ref x"
    assert {r.term for r in term_counts(df, spec).collect()} == set("a title see supplier the one c d k e1 open ref x".split())


def test_tasks_that_count_typed_tokens_grow_in_number(spark, sf_dir, monkeypatch):
    from conceptile import catalog

    monkeypatch.setattr(catalog, "PAGES", 20)
    plan = catalog.QUERIES["typed_tokens"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    tasks = -(-spark.read.parquet(f"{sf_dir}/part.parquet").count() // 20)
    assert re.search(rf"hashpartitioning\(p_partkey#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan)
