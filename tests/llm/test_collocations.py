"""Phrases counted one by one in plain Python, and in SQL, against pivot partitioning."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conceptile.llm import collocations as C
from conceptile.llm.common import Scratch


def counted(rows, least=30, share=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        g = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[g] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[g][tuple(w[i : i + k])] += 1
    out = []
    for g, n in f.items():
        cands = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        rows_ = []
        for p, a in cands.items():
            if 100 * inner[p] >= share * a:
                continue
            score, k = min((2000000 * a // (n[p[:k]] + n[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((g, rank, p.decode(), -a, l, r, total[g], -s))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocab = ["the", "of", "New", "York", "city", "é", "naïve", "a", "b", "x#1", "日本", "🙂"] + [f"w{i}" for i in range(30)]
    rows = []
    for d in range(150):
        words = rng.choices(vocab, weights=[30, 20, 10, 2, 2, 5, 5, 9, 9, 3, 3, 3] + [1] * 30, k=rng.randrange(1, 120))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for w in words)
        text = text.replace("New ", "new york city ") if d % 3 else text
        rows.append((d, text, ("en", "en", "de", None, "und")[d % 5]))
    rows += [(200, None, "en"), (201, "", "fr"), (202, "a " * 5000, "en"), (203, "q q q q q. " * 40, "fr"), (None, "the of " * 50, "en"), (0, rows[0][1], "en"), (0, rows[0][1], "en")]
    rows.append((204, "In the end of it; " * 30_000, "es"))
    return rows


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_phrases_equal_a_plain_count(spark, docs, table_dir, rows):
    d = table_dir(documents=docs(rows, ["rank", "phrase", "n", "score"]))
    found, want = got(C.op12_collocations(spark, d)), counted(rows)
    assert found == want and len(want) > 20


def test_sql_says_the_same(spark, docs, table_dir, rows):
    d = table_dir(documents=docs(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert got(C.op12_collocations(spark, d)) == sorted(con.sql(C.SQL).fetchall())


@pytest.mark.parametrize("slots, hot", [(2, 1 << 18), (1 << 10, 40), (3, 7)])
def test_crowded_tables_and_dealt_pivots_change_nothing(spark, docs, rows, slots, hot):
    small = [r for r in rows if r[0] != 204]
    assert got(C.collocations(docs(small), Scratch(spark), slots=slots, hot=hot)) == counted(small)


def test_other_thresholds_and_a_short_list(spark, docs, rows):
    small = [r for r in rows if r[0] != 204]
    assert got(C.collocations(docs(small), Scratch(spark), least=5, share=100, top=40)) == counted(small, 5, 100, 40)


def test_long_texts_are_cut_where_pieces_end(monkeypatch, spark, docs):
    assert b".".join(C.cut(b"one two, three. four five six! seven", 9)) == b"one two. three. four five six. seven"
    assert list(C.cut(b"no end at all in here", 4)) == [b"no end at all in here"]


def test_empty_table(spark, docs, table_dir):
    assert got(C.op12_collocations(spark, table_dir(documents=docs([])))) == []
    assert got(C.op12_collocations(spark, table_dir(documents=docs([(1, None, None), (2, "a b", "en")])))) == []
