"""Titles, links and categories: joins and iterations over edge tables.

Iterations write each round's table to the shared checkpoint folder, so that lineage stays short and a lost executor costs no
more than a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .analyze import once
from .staging import shared_root


def ensure_checkpoints(df: DataFrame) -> DataFrame:
    """The frame, checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def excluded_title(title: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.lower(title).rlike(p)
    return out


def title_map(pages: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(title, redirect) of pages (title, text): normalised, the redirect being the title itself for articles."""
    title = T.normalize_title(F.col("title"))
    rows = pages.select(title.alias("title"), F.coalesce(T.redirect_target(F.col("text")), title).alias("redirect"))
    return rows.where(~excluded_title(F.col("title"), excluded or []) & ~excluded_title(F.col("redirect"), excluded or []))


def one_redirect(titles: DataFrame) -> DataFrame:
    """(title, redirect) with one row a title. Titles that normalise alike meet here: an article wins over redirects of its title,
    and the least redirect over others."""
    other = F.min(F.when(F.col("redirect") != F.col("title"), F.col("redirect")))
    article = F.max(F.col("redirect") == F.col("title"))
    one = titles.where("title is not null and redirect is not null").groupBy("title").agg(article.alias("article"), other.alias("other"))
    return one.select("title", F.when(F.col("article"), F.col("title")).otherwise(F.col("other")).alias("redirect"))


def redirect_closure(titles: DataFrame) -> DataFrame:
    """(title, target), a row for each title: redirects followed to their end, by doubling. Titles on a cycle lead to the least title
    of the cycle; of a title that occurs several times one redirect counts (``one_redirect``), so that no round adds rows. Articles
    are their own ends: only redirects take part in the rounds."""
    titles = ensure_checkpoints(one_redirect(titles))
    ends = titles.where("title = redirect").select("title", F.col("redirect").alias("target"))
    moves = titles.where("title <> redirect")
    rows = moves.count()
    if not rows:
        return ends
    hop = moves.select("title", F.col("redirect").alias("target"), F.least("title", "redirect").alias("least"))
    steps = 1
    while True:
        nxt = hop.select(F.col("title").alias("target"), F.col("target").alias("t2"), F.col("least").alias("l2"))
        after = hop.join(nxt, "target", "left").select("title", F.coalesce("t2", "target").alias("target"), F.least("least", F.coalesce("l2", "least")).alias("least"), (F.col("t2").isNotNull() & (F.col("t2") != F.col("target"))).alias("moved"))
        after = ensure_checkpoints(after)
        moved, hop, steps = after.where("moved").count(), after.drop("moved"), steps * 2
        # all have ended, or gone longer than any path: what leads into a cycle has been round it, and its titles have its least
        if moved == 0 or steps > 2 * (rows + 1):
            turns = hop.select(F.col("title").alias("target"), F.col("least").alias("end"))  # an end that is a redirect is on a cycle
            return ends.unionByName(hop.join(turns, "target", "left").select("title", F.coalesce("end", "target").alias("target")))


def named_edges(names: DataFrame, targets: DataFrame, valid: DataFrame) -> DataFrame:
    """(src, dst), each once: what the names (src, title) lead to by the targets (title, target), where that is a valid title."""
    reached = targets.join(valid.select(F.col("title").alias("target")), "target", "left_semi")
    return names.join(reached, "title").select("src", F.col("target").alias("dst")).distinct()


def link_names(articles: DataFrame) -> DataFrame:
    """(src, title): the normalised names of an article's links; (title, text) in, titles normalised."""
    raw = articles.select(F.col("title").alias("src"), F.explode(once(F.array_distinct(T.raw_links(F.col("text"))))).alias("raw"))
    return raw.select("src", once(T.normalize_title(F.col("raw"))).alias("title"))


def link_edges(articles: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst): distinct links between valid articles (title, text); targets (title, target) resolve what links name."""
    named = articles.select(T.normalize_title(F.col("title")).alias("title"), "text")
    return named_edges(link_names(named), targets, named)


def counted_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title, incoming) and (title, outgoing) of the titles that have any; links to oneself count."""
    count = lambda c, name: edges.groupBy(F.col(c).alias("title")).agg(F.count("*").alias(name))
    return count("dst", "incoming"), count("src", "outgoing")


def link_counts(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """(title, incoming, outgoing) for all articles; links to oneself count."""
    ins, outs = counted_edges(edges)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    titles = articles.select(T.normalize_title(F.col("title")).alias("title")).distinct()
    return titles.join(ins, "title", "left").join(outs, "title", "left").select("title", zero("incoming"), zero("outgoing"))


def link_core(edges: DataFrame, least: int) -> DataFrame:
    """The edges (src, dst) left when sources and targets of fewer than ``least`` edges are dropped until none is."""
    edges = ensure_checkpoints(edges.select("src", "dst").distinct())
    n = edges.count()
    while True:
        for c in ("src", "dst"):
            enough = edges.groupBy(c).count().where(F.col("count") >= least).select(c)
            edges = edges.join(enough, c, "left_semi")
        edges = ensure_checkpoints(edges.select("src", "dst"))
        n, before = edges.count(), n
        if n == before:
            return edges


def core_titles(edges: DataFrame) -> DataFrame:
    """What is both a source and a target."""
    return edges.select(F.col("src").alias("title")).distinct().join(edges.select(F.col("dst").alias("title")).distinct(), "title", "left_semi")


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): all that the seeds (node) reach over edges (parent, child), with the least number of steps; cycles end."""
    seen = ensure_checkpoints(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        depth += 1
        step = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front = ensure_checkpoints(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = ensure_checkpoints(seen.unionByName(front))


def category_edges(pages: DataFrame) -> DataFrame:
    """(parent, child): what category pages are filed under; (title, text) in, titles normalised."""
    title = T.normalize_title(F.col("title"))
    return pages.where(title.startswith("category:")).select(F.explode(T.categories(F.col("text"))).alias("parent"), title.alias("child")).distinct()


def category_counts(pages: DataFrame) -> DataFrame:
    """(category, articles): how many pages are filed under each."""
    return pages.select(T.normalize_title(F.col("title")).alias("title"), F.explode(T.categories(F.col("text"))).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("articles"))


def category_info(pages: DataFrame) -> DataFrame:
    """(category, articles, subcategories): what is filed under each category, pages and categories apart."""
    title = T.normalize_title(F.col("title"))
    filed = pages.select(title.startswith("category:").alias("sub"), title.alias("title"), F.explode(T.categories(F.col("text"))).alias("category")).distinct()
    return filed.groupBy("category").agg(F.count(F.when(~F.col("sub"), 1)).alias("articles"), F.count(F.when(F.col("sub"), 1)).alias("subcategories"))


def in_categories(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """The titles filed under one of the categories (node)."""
    filed = pages.select("title", F.explode(T.categories(F.col("text"))).alias("node"))
    return filed.join(categories, "node", "left_semi").select("title").distinct()


def can_index(incoming: Column, outgoing: Column, terms: Column, min_in: int = 0, min_out: int = 0, min_terms: int = 0, max_terms: int = 0) -> Column:
    """Bounds on an article's numbers; 0 is no bound, and what isn't known passes."""
    out = F.lit(True)
    for c, least in ((incoming, min_in), (outgoing, min_out), (terms, min_terms)):
        if least > 0:
            out = out & F.coalesce(c >= least, F.lit(True))
    return out & F.coalesce(terms <= max_terms, F.lit(True)) if max_terms > 0 else out


def title_boost(title: Column) -> Column:
    lower = F.lower(title)
    return F.lit(1.0) + F.when(lower.startswith("category"), 1.5).when(lower.startswith("list of"), 0.7).otherwise(0.0)


def wiki_records(pages: DataFrame) -> DataFrame:
    """(title, text, links, incoming, boost): what an index of pages (title, text, incoming_links) stores of each; links are the different ones, in the
    order of the text; incoming is 0 where it isn't known. Pages without a title or a text are left out."""
    whole = pages.where(T.non_empty(F.col("title")) & T.non_empty(F.col("text")))
    return whole.select("title", "text", F.array_distinct(T.links(F.col("text"))).alias("links"), F.coalesce("incoming_links", F.lit(0)).alias("incoming"), title_boost(F.col("title")).alias("boost"))


#: fixed value: what the titles of templates have that are left out of the text
STRIPPED_TEMPLATES = "stub|user[ s]|disambig|copy-?edit|cleanup|page|article|/meta|/doc|category|documentation|cite|css|see below|see at|aka|see above|image|/format|wiki|disputed|please|wrongtitle|color([^a]|$)|font|lang-|time zone|icon|todo|style/|unit of|^template:[.]{1,3}$|warn-|^template:.*template.*$|discussion|usertalk|column|col-| age |did you know|uw-|see also|this is|don't|word|split|styles|^template:[A-Z]+$|citation|str "


def title_matcher(title: Column, patterns: list[str] | None = None, starts: list[str] | None = None, contains: list[str] | None = None) -> Column:
    """Whether any condition holds."""
    out = F.lit(False)
    for p in patterns or []:
        out = out | title.rlike(p)
    for s in starts or []:
        out = out | title.startswith(s)
    for c in contains or []:
        out = out | title.contains(c)
    return out


def stripped_template(title: Column) -> Column:
    """Whether a template of this title (as it is written, with its namespace) is left out by the built-in pattern."""
    return title_matcher(title, [STRIPPED_TEMPLATES])


def article_stats(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """One row over articles (doc_id, incoming, outgoing) and their term counts (doc_id, term, tf)."""
    per = counts.groupBy("doc_id").agg(F.sum("tf").alias("terms"), F.count("*").alias("unique"))
    a = articles.join(per, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing", "terms", "unique")])
    best = lambda c: F.max_by("doc_id", F.struct(F.col(c), -F.col("doc_id"))).alias(f"most_{c}")
    whole = a.agg(F.count("*").alias("docs"), *[F.sum(c).alias(f"sum_{c}") for c in ("terms", "unique", "incoming", "outgoing")], *[F.avg(c).alias(f"mean_{c}") for c in ("terms", "unique", "incoming", "outgoing")], *[best(c) for c in ("terms", "unique", "incoming", "outgoing")])
    return whole.join(counts.agg(F.count_distinct("term").alias("distinct_terms")))
