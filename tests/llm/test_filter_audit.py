"""Every order of the filters, applied one document at a time, against the operator."""

import re
from itertools import permutations

import duckdb
import pytest
from conceptile.llm.filter_audit import SQL, op13_filter_audit

LABELS = "doc_id long, quality int, toxic int"


def simulated(rows, labels):
    """rows: (doc_id, text, lang). Filters applied in turn, for every order."""
    texts = [(d, t or "", g or "") for d, t, g in rows]

    def fails(d, text, letter):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        if letter == "A":
            return len(w) < 200
        if letter == "B":
            return 100 * len(set(w)) < 50 * len(w)
        if letter == "C":
            return 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)
        if letter == "D":
            return bool(re.search(r"[#$%&*|]", text))
        return d is not None and any(e is not None and e < d and t == text for e, t, _ in texts)

    verdicts = [{x: fails(d, t, x) for x in "ABCDE"} for d, t, _ in texts]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {g for _, _, g in texts}:
        mine = [i for i, (_, _, g) in enumerate(texts) if g == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [i for i in left if verdicts[i][x]]
                redundant = sum(verdicts[i][x] for i in mine) - len(gone)
                left = [i for i in left if not verdicts[i][x]]
                total[x] += len(gone)
                alone = sum(verdicts[i][x] and sum(verdicts[i].values()) == 1 for i in mine)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(texts[i][0] in good for i in gone), sum(texts[i][0] in toxic for i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def found(spark, d):
    rows = op13_filter_audit(spark, d).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    return got


def long_text(i, n=210, extra=""):
    return " ".join(f"w{i}x{j}" for j in range(n)) + extra


@pytest.fixture(scope="module")
def rows():
    out = [(0, long_text(0), "en", "s"), (1, long_text(0), "de", "s"), (2, None, "en", "s"), (3, "", "en", None), (4, long_text(4, extra=" #"), None, "s"), (5, "A" * 50 + " " + long_text(5), "", "s"), (6, "same " * 300, "en", "s"), (7, "same " * 300, "en", "s"), (7, "same " * 300, "en", "s"), (None, long_text(0), "en", "s"), (None, None, None, None), (8, "x " * 200_000 + "B" * 20_000 + "|", "de", "s")]
    return out + [(20 + i, long_text(i % 3, 150 + 30 * (i % 4), " %" * (i % 2)), ("en", "de")[i % 2], "s") for i in range(40)]


@pytest.fixture(scope="module")
def labels(spark):
    return [(0, 1, 0), (0, 0, 1), (1, 1, None), (6, None, 1), (7, 1, 1), (None, 1, 1), (999, 1, 1), (25, 1, 0), (26, 0, 1)]


def test_all_orders_equal_filters_in_turn(spark, docs, table_dir, rows, labels):
    d = table_dir(documents=docs(rows, ["part", "mask", "digest", "n"]), labels=spark.createDataFrame(labels, LABELS))
    got = found(spark, d)
    assert got == simulated([r[:3] for r in rows], labels) and len(got) == 3 * 600


def test_sql_says_the_same(spark, docs, table_dir, rows, labels):
    d = table_dir(documents=docs(rows), labels=spark.createDataFrame(labels, LABELS))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = {(p, o, s): list(v) for p, o, s, *v in con.sql(SQL).fetchall()}
    assert found(spark, d) == want


def test_empty_tables(spark, docs, table_dir):
    d = table_dir(documents=docs([]), labels=spark.createDataFrame([], LABELS))
    assert found(spark, d) == {}
    d = table_dir(documents=docs([(1, "one", "en")]), labels=spark.createDataFrame([], LABELS))
    assert found(spark, d) == simulated([(1, "one", "en")], [])
