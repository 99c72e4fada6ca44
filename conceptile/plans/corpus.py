"""Corpus preparation: from a dump to annotated articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.templates import TemplateTable, reachable, template_bodies
from ..operators.analyze import DEFAULT, AnalyzerSpec, once
from ..operators.graph import category_edges, counted_edges, descendants, excluded_title, in_categories, link_names, named_edges, redirect_closure, stripped_template
from ..operators.staging import kept


@dataclass(frozen=True)
class PrepareSpec:
    excluded_titles: tuple[str, ...] = ()
    keep_stubs: bool = False
    depth: int = 5
    min_template_terms: int = 0
    strip_templates: bool = True  # by the built-in pattern


def prepared(pages: DataFrame, seeds: DataFrame | None = None, spec: PrepareSpec = PrepareSpec()) -> DataFrame:
    """(title, text) of the articles of a dump (title, text): no categories, redirects, stubs, excluded titles or articles under
    the seed categories (node) or their descendants; templates expanded, attributes scrubbed."""
    pages = pages.where(T.non_empty(F.col("title")) & T.non_empty(F.col("text")))
    title = T.normalize_title(F.col("title"))
    kept = pages.where(~title.startswith("category:") & ~title.startswith("template:") & ~excluded_title(F.col("title"), list(spec.excluded_titles)) & T.redirect_target(F.col("text")).isNull())
    if not spec.keep_stubs:
        kept = kept.where(~T.is_stub(F.col("text")))
    stripped = stripped_template(F.col("title")) if spec.strip_templates else None
    bodies = template_bodies(pages, stripped, spec.min_template_terms)
    table = TemplateTable(pages.sparkSession, reachable(bodies, kept.select("text"), spec.depth), spec.depth)
    articles = kept.select(title.alias("title"), table.expanded(F.col("text"), F.col("title")).alias("text"))
    if seeds is not None:
        out = in_categories(articles, descendants(category_edges(pages), seeds).select("node"))
        articles = articles.join(out, "title", "left_anti")
    return articles.select("title", T.scrub_attributes(F.col("text")).alias("text"))


def annotated(articles: DataFrame, titles: DataFrame | None = None, min_in: int = 0, min_out: int = 0, min_terms: int = 0, analyzer: AnalyzerSpec = DEFAULT) -> DataFrame:
    """(title, text, incoming_links, outgoing_links, terms) of the articles that reach the minima; links go to such articles only
    as have enough terms, over redirects. Texts are made, tokenised and searched for redirects once, into a kept table."""
    title = T.normalize_title(F.col("title"))
    own = articles.select(title.alias("title"), "text", F.coalesce(T.redirect_target(F.col("text")), title).alias("redirect"), once(F.size(analyzer.tokens(F.col("text")))).alias("terms"))
    own = kept(own, "articles")
    valid = own.where(F.col("terms") >= min_terms)
    targets = redirect_closure(titles if titles is not None else own.select("title", "redirect"))
    ins, outs = counted_edges(kept(named_edges(link_names(valid), targets, valid), "edges"))
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("incoming", "outgoing")]
    out = valid.where("title is not null").join(ins, "title", "left").join(outs, "title", "left").select("title", "text", *numbers, "terms")
    out = out.where((F.col("incoming") >= min_in) & (F.col("outgoing") >= min_out))
    return out.select("title", "text", F.col("incoming").cast("int").alias("incoming_links"), F.col("outgoing").cast("int").alias("outgoing_links"), "terms")


def repeated(articles: DataFrame, link_repeat: int, title_repeat: int) -> DataFrame:
    return articles.withColumn("text", T.repeat_content(F.col("title"), F.col("text"), link_repeat, title_repeat))
