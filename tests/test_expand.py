"""Expansion by joins equals expansion with all templates at hand."""

import random

import pytest
from conceptile.functions.templates import TemplateTable
from conceptile.operators import expand as E
from pyspark.sql import functions as F
from test_wiki import TEMPLATES

ARTICLES = ["{{hi|Al}}", "{{named|who=Al}}", "{{mix|p|k=q|r}}", "{{out}}", "{{named}}", "{{def}}", "{{t1}}", "{{p|v=z}}", "{{nope|a=1|b=2}}", "x {{lc:AB|c}} y", "{{#if: a|b}}", "at {{PAGENAME}}", "{{#tag:b|one|two}}", "{{a", "{{[x]}}", "", None, "{{hi|{{hi|{{hi|deep}}}}}} {{hi|Al}} {{hi|Al}}", "{{call|hi}} {{call|t5}} {{call|nope}}", "{{dyn|out}}"]
MORE = TEMPLATES | {"call": "<{{ {{{1}}} |v}}>", "dyn": "{{call|{{{1}}}}} {{call|in}}"}


def both(spark, pages, templates, **options):
    bodies = spark.createDataFrame(list(templates.items()), "name string, body string")
    table = TemplateTable(spark, bodies, **options)
    want = {r.id: r.x for r in pages.select("id", table.expanded(F.col("text"), F.col("title")).alias("x")).collect()}
    got = E.expanded_pages(pages, bodies, block=200, **options)
    assert got.columns == pages.columns
    rows = got.collect()
    assert len(rows) == len(want) and {r.id: r.text for r in rows} == want
    return want


def test_fixtures(spark):
    pages = spark.createDataFrame([(i, "Home", t, "clash") for i, t in enumerate(ARTICLES)], "id int, title string, text string, row string")
    want = both(spark, pages, MORE)
    assert want[0] == "yo Al" and want[16] is None
    both(spark, pages, MORE, depth=2)
    both(spark, pages, MORE, most=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_templates(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]

    def body(depth=0):
        kinds = ["w", " ", "{{{1}}}", "{{{k|d}}}", "{{PAGENAME}}"]
        parts = rng.choices(kinds, k=rng.randrange(1, 5))
        for _ in range(rng.randrange(3 - min(depth, 2))):
            name = rng.choice([*names, "unknown", "{{{1}}}"])
            parts.append(f"{{{{{name}|{rng.choice(['x', 'k=y', rng.choice(names), body(depth + 1)])}}}}}")
        return "".join(parts)

    templates = {n: body() for n in names}
    pages = spark.createDataFrame([(i, f"T{i}", body()) for i in range(60)], "id int, title string, text string")
    both(spark, pages, templates)


def test_repeated_rows_and_no_templates(spark):
    pages = spark.createDataFrame([(1, "A", "{{hi|x}}"), (1, "A", "{{hi|x}}"), (2, None, "{{PAGENAME}}!")], "id int, title string, text string")
    none = spark.createDataFrame([], "name string, body string")
    assert sorted((r.id, r.text) for r in E.expanded_pages(pages, none).collect()) == [(1, "x "), (1, "x "), (2, "!")]
    assert E.expanded_pages(pages.limit(0), none).collect() == []
