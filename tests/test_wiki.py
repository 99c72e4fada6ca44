import bz2

import pytest
from conceptile.functions import text as T
from conceptile.functions.porter import porter
from conceptile.functions.templates import TemplateTable, expand, normal_title, parsed_templates, references, template_bodies
from conceptile.operators import graph as G
from conceptile.plans.corpus import PrepareSpec, annotated, prepared, repeated
from conceptile.sources import files as S
from pyspark.sql import functions as F

TITLES = {"Category:Foo_Bar  baz": "category:foo Bar baz", "Hello: World": "hello: World", "A:B:C": "a:b:C", " X y": "X y", ":Xy": ":xy", " _Q ": "Q", "": "", "É_x": "é x"}
TEMPLATES = {"hi": "yo {{{1}}}", "named": "yo {{{who}}}", "mix": "{{{1}}}-{{{k}}}-{{{3}}}", "out": "[ {{in}} ]", "in": "x", "def": "yo {{{who|all}}}", **{f"t{i}": f"{{{{t{i + 1}}}}}" for i in range(1, 6)}, "t6": "end", "p": "{{q|v={{{v}}}}}", "q": "{{p|v={{{v}}}}}"}


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_titles(spark):
    assert dict(zip(TITLES, column(spark, TITLES, T.normalize_title), strict=True)) == TITLES
    assert {t: normal_title(t) for t in TITLES} == TITLES
    assert column(spark, [None], T.normalize_title) == [None]


def test_markup(spark):
    assert column(spark, ["[[File:x.png]] [[Cat|cats]] [[dog#Habits]] [[Image:y]] [[big_Cat]]"], T.links) == [["cat", "dog", "big Cat"]]
    assert column(spark, ["[[Category:A_b|x]] [[ category:C]] [[Category:A b]]"], T.categories) == [["category:a b", "category:c"]]
    assert column(spark, ["a+b (c)~d"], T.standard) == ["a b  c d"]
    assert column(spark, ["a<noinclude>b</noinclude>c<noinclude>d</noinclude>e"], T.without_noinclude) == ["ae"]
    assert column(spark, ["a<onlyinclude>b</onlyinclude>c", "plain"], T.only_included) == ["b", "plain"]
    assert column(spark, ["#REDIRECT [[Home_page]]", "x\n#REDIRECT [[Home]]", "no"], T.redirect_target) == ["home page", None, None]
    assert column(spark, ["{{geo-stub}}", "{{Stub|x}}", "{{cite}} stub", "x stub}}"], T.is_stub) == [True, True, False, True]
    assert column(spark, ["{| align = left | x"], T.scrub_attributes) == ["{  x"]
    row = spark.createDataFrame([("T", "t [[Ab]]")], "title string, text string")
    assert repeated(row, 2, 1).first().text == "t [[Ab]] ab ab T"
    assert column(spark, ["U.S.A. it's a.bc"], lambda c: F.transform(T.tokens(c, T.CLASSIC_TOKEN), T.classic)) == [["USA", "it", "a.bc"]]
    assert column(spark, ["a, b!"], T.rejoined) == ["a b "]


def test_singular_and_porter(spark):
    words = ["ponies", "eies", "dies", "bus", "glass", "shoes", "trees", "cats", "is", "aes", "horses"]
    assert column(spark, words, T.singular) == ["pony", "eies", "dy", "bus", "glass", "shoes", "trees", "cat", "is", "aes", "horse"]
    known = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: porter(w) for w in known} == known


@pytest.mark.parametrize(
    ("article", "want"),
    [
        ("{{hi|Al}}", "yo Al"), ("{{named|who=Al}}", "yo Al"), ("{{mix|p|k=q|r}}", "p-q-r"), ("{{out}}", "[ x ]"), ("{{named}}", "yo {{{who}}}"), ("{{def}}", "yo all"), ("{{t1}}", "{{t6}}"),
        ("{{p|v=z}}", "z "), ("{{nope|a=1|b=2}}", "1 2 "), ("x {{lc:AB|c}} y", "x AB|c y"), ("{{#if: a|b}}", ""), ("at {{PAGENAME}}", "at Home"), ("{{#tag:b|one|two}}", "one|two"), ("{{a", "{{a"), ("{{[x]}}", "{{[x]}}"),
    ],
)
def test_expansion(article, want):
    assert expand(article, "Home", TEMPLATES) == want


def test_references():
    (one,) = references("{{n | k = v | w }}")
    assert (one.name, one.parameters) == ("n", [(1, "k", "v"), (2, "2", " w ")])
    (two,) = references("{{a|{{b|c}}}}")
    assert two.parameters == [(1, "1", "{{b|c}}")]
    assert not list(references("{{[x]}}")) and not list(references("{{a")) and not list(references("{{__TOC__}} {{ns:x}} {{{v}}}"))
    assert [r.name for r in references("{{a|[[x|y]]}} {{b|=|}} {{uc:x|y}}")] == ["a", "b", "uc:x|y"]


def test_templates_over_columns(spark):
    pages = spark.createDataFrame([("Template:Hi", "<noinclude>doc</noinclude>yo {{{1}}}"), ("Template:Skip", "{{#invoke:x}}"), ("Page", "{{hi|Al}} {{skip|v}}")], "title string, text string")
    table = TemplateTable(spark, template_bodies(pages))
    assert table.templates == {"hi": "yo {{{1}}}"}
    assert pages.where("title = 'Page'").select(table.expanded(F.col("text"), F.col("title"))).first()[0] == "yo Al v "
    assert [r["name"] for r in pages.where("title = 'Page'").select(parsed_templates(F.col("text"))).first()[0]] == ["hi", "skip"]
    with pytest.raises(ValueError):
        TemplateTable(spark, template_bodies(pages), limit=3)


def test_redirects_follow_to_their_end_and_cycles_end(spark):
    rows = [("A", "B"), ("B", "C"), ("C", "C"), ("X", "Y"), ("P", "Q"), ("Q", "P"), ("L", "P"), ("M", "L"), *[(f"n{i:03}", f"n{i + 1:03}") for i in range(40)], ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    got = {r.title: r.target for r in G.redirect_closure(spark.createDataFrame(rows, "title string, redirect string")).collect()}
    assert {k: got[k] for k in "ABCXPQLM"} == {"A": "C", "B": "C", "C": "C", "X": "Y", "P": "P", "Q": "P", "L": "P", "M": "P"}
    assert got["n000"] == got["n039"] == "n040" and {got[k] for k in ("r1", "r2", "r3")} == {"r1"}


def test_link_counts(spark):
    pages = spark.createDataFrame([("a", "[[b]] [[bb]] [[z]]"), ("b", "[[a]] [[b]]"), ("c", "")], "title string, text string")
    targets = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("bb", "b")], "title string, target string")
    got = {r.title: (r.outgoing, r.incoming) for r in G.link_counts(pages, G.link_edges(pages, targets)).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (0, 0)}


def test_link_core_cascades(spark):
    full = [(x, y) for x in "abc" for y in "abc" if x != y]
    for more in ([("d", "a")], [("a", "d"), ("d", "a"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "e")]):
        core = G.link_core(spark.createDataFrame(full + more, "src string, dst string"), 2)
        assert {r.title for r in G.core_titles(core).collect()} == {"a", "b", "c"}


def test_categories(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "a"), ("z", "q")], "parent string, child string")
    got = {r.node: r.depth for r in G.descendants(edges, spark.createDataFrame([("s",)], "node string")).collect()}
    assert got == {"s": 0, "a": 1, "b": 2}


def test_can_index(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (None, 5), (3, 10), (3, 9)], "i int, t int")
    assert [r[0] for r in df.select(G.can_index(F.col("i"), F.col("i"), F.col("t"), min_in=2, max_terms=9)).collect()] == [False, True, True, False, True]


def test_a_dump_becomes_annotated_articles(spark, tmp_path):
    page = lambda t, x: f"<page><title>{t}</title><revision><text bytes='1'>{x}</text></revision></page>"
    body = "".join([page("Cat", "{{Hi|cats}} [[Dog]] [[Doggy]] more words"), page("Dog", "a [[cat]] barks [[Category:Pets]]"), page("Doggy", "#REDIRECT [[Dog]]"), page("Template:Hi", "hello {{{1}}}"), page("Category:Animals", "top"), page("Category:Pets", "[[Category:Animals]]"), page("Bad thing", "text"), page("Small", "{{x-stub}}"), page("Empty", "")])
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(b"<mediawiki>" + body.encode()[:200]) + bz2.compress(body.encode()[200:] + b"</mediawiki>"))
    pages = S.dump_xml(spark, str(tmp_path / "d.xml.bz2"))
    got = {r.title: r.text for r in prepared(pages, spec=PrepareSpec(("bad",))).collect()}
    assert got == {"cat": "hello cats [[Dog]] [[Doggy]] more words", "dog": "a [[cat]] barks [[Category:Pets]]"}
    seeds = spark.createDataFrame([("category:animals",)], "node string")
    assert [r.title for r in prepared(pages, seeds, PrepareSpec(("bad",))).collect()] == ["cat"]
    articles = prepared(pages, spec=PrepareSpec(("bad",)))
    noted = annotated(articles, G.title_map(pages), 1, 1)
    assert {(r.title, r.incoming_links, r.outgoing_links) for r in noted.collect()} == {("cat", 1, 1), ("dog", 1, 1)}
    S.write_xml(noted.select("title", "text", F.col("incoming_links").alias("incomingLinks"), F.col("outgoing_links").alias("outgoingLinks"), "terms"), str(tmp_path / "out"))
    assert {(r.title, r.incoming_links) for r in S.articles_xml(spark, str(tmp_path / "out")).collect()} == {("cat", 1), ("dog", 1)}


def test_annotated_makes_each_text_once(spark):
    """Titles are normalised once, too: one that another pass would change keeps its links."""
    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return x

    rows = [("_X:Y", "to [[B]]"), ("B", "to [[_X:Y]] and [[ x:Y]], [[B]], [[Gone]]"), ("C", "#REDIRECT [[B]]"), ("D", "[[C]] [[b]]")]
    pages = spark.createDataFrame(rows, "title string, text string").withColumn("text", F.udf(text, "string").asNondeterministic()("text"))
    got = annotated(pages, min_in=1).collect()
    assert {(r.title, r.incoming_links, r.outgoing_links) for r in got} == {("X:y", 1, 1), ("b", 4, 2)}
    assert made.value == len(rows)


def test_small_sources(spark, tmp_path):
    (tmp_path / "w.txt").write_text("The\n\nof\nTHE\n")
    assert {r.term for r in S.words(spark, str(tmp_path / "w.txt"), ["More"]).collect()} == {"the", "of", "more"}
    (tmp_path / "g.csv").write_text("1,2,7.5\n2,1,10\n")
    (tmp_path / "d.csv").write_text('\n"first, text"\n"second"\n')
    docs = S.numbered_documents(spark, str(tmp_path / "d.csv"))
    got = S.judged_texts(S.gold_pairs(spark, str(tmp_path / "g.csv")), docs).orderBy("doc1").collect()
    assert [(r.human, r.text1, r.text2) for r in got] == [(0.75, "first, text", "second"), (1.0, "second", "first, text")]
    (tmp_path / "x.xml").write_text("<r><dream><id>1</id><title>T</title><content>c</content><user>u</user></dream><dream><id>2</id></dream></r>")
    assert [(r.id, r.text, r.user) for r in S.dreams_xml(spark, str(tmp_path / "x.xml")).collect()] == [("1", "T c", "u")]
    assert S.whole_text(spark, str(tmp_path / "w.txt")).first().text == "The\n\nof\nTHE\n"
    S.write_terms(S.words(spark, str(tmp_path / "w.txt")), str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"the", "of"}


def test_repeated_titles_lead_to_one_target(spark):
    """Two rows for one title, on a path of many hops: a row for each title, whatever the number of rounds."""
    rows = [("a", "b"), ("a", "c"), ("a", "b"), ("x", "y"), ("x", "x"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(30) for _ in range(3)], ("n30", "n30"), ("n30", "n30"), ("b", "n00"), ("p", "q"), ("p", "q"), ("q", "p"), (None, "a")]
    got = G.redirect_closure(spark.createDataFrame(rows, "title string, redirect string")).collect()
    assert len(got) == len({r.title for r in got}) == 36
    target = {r.title: r.target for r in got}
    assert target["a"] == target["b"] == target["n00"] == "n30" and target["x"] == "x" and target["p"] == target["q"] == "p"
    pages = spark.createDataFrame([("a_b", "[[c]]"), ("A b", "#REDIRECT [[c]]"), ("c", "[[a b]]")], "title string, text string")
    links = G.link_edges(pages.limit(3), G.redirect_closure(G.title_map(pages)))
    assert {(r.src, r.dst) for r in links.collect()} == {("a b", "c"), ("c", "a b")}


def test_built_in_template_pattern_and_minimum(spark):
    titles = ["Template:Geo-stub", "Template:Infobox color", "Template:Infobox cola", "Template:ABC", "Template:Taxon", "Template:str x"]
    assert column(spark, titles, G.stripped_template) == [True, True, False, False, False, True]
    pages = spark.createDataFrame([("Template:Long", "one two three"), ("Template:Short", "one"), ("Template:long", "zzz four five")], "title string, text string")
    assert [(r.name, r.body) for r in template_bodies(pages, min_terms=2).collect()] == [("long", "one two three")]


def test_templates_are_cut_down_to_what_pages_reach(spark):
    from conceptile.functions.templates import reachable

    bodies = spark.createDataFrame([("a", "x {{b|{{c}}}}"), ("b", "y"), ("c", "{{d}}"), ("d", "{{a}} {{e}}"), ("e", "deep"), ("z", "unused {{a}}")], "name string, body string")
    texts = spark.createDataFrame([("{{A|1}} and",), (None,), ("none",)], "text string")
    names = lambda depth: sorted(r.name for r in reachable(bodies, texts, depth).collect())
    assert names(5) == ["a", "b", "c", "d", "e"] and names(1) == ["a", "b", "c"]
    table = TemplateTable(spark, reachable(bodies, texts, 5))
    assert set(table.templates) == {"a", "b", "c", "d", "e"}


def test_similarities_by_name(spark):
    from math import log, sqrt

    from conceptile.functions.weights import similarity

    row = spark.createDataFrame([(3.0, 20.0, 10.0, 100.0, 4.0)], "f double, dl double, m double, n double, df double")
    score = lambda name: row.select(similarity(name)(*[F.col(c) for c in ("f", "dl", "m", "n", "df")], F.lit(2.0))).first()[0]
    tf = 3 / (3 + 1.2 * (0.25 + 0.75 * 2))
    want = {"BM25": 2 * log(1 + 96.5 / 4.5) * tf, "TFIDF": 2 * sqrt(3) * (log(101 / 5) + 1) ** 2 / sqrt(20), "trueBM25": 2 * 24 * tf, "trueTFIDF": 2 * 3 * 24, "other": 2 * log(1 + 96.5 / 4.5) * tf}
    assert {k: round(score(k), 9) for k in want} == {k: round(v, 9) for k, v in want.items()}


def test_numbers_without_a_document_are_an_error(spark, tmp_path):
    (tmp_path / "g.csv").write_text("1,9,7.5\n")
    (tmp_path / "d.csv").write_text('"first"\n')
    with pytest.raises(Exception, match="no document 9"):
        S.judged_texts(S.gold_pairs(spark, str(tmp_path / "g.csv")), S.numbered_documents(spark, str(tmp_path / "d.csv"))).collect()


def test_category_info_and_token_dump(spark):
    from conceptile.operators.analyze import dumped_tokens

    pages = spark.createDataFrame([("a", "[[Category:X]]"), ("b", "[[Category:X]] [[Category:Y]]"), ("Category:Y", "[[Category:X]]")], "title string, text string")
    assert {(r.category, r.articles, r.subcategories) for r in G.category_info(pages).collect()} == {("category:x", 2, 1), ("category:y", 1, 0)}
    assert dumped_tokens(spark.createDataFrame([(1, "A b, C")], "doc_id long, text string")).first().tokens == "a b c"


def test_scores_of_a_store_are_read_in_order_and_pruned(spark):
    rows = [("t", i, 1.0 / (i + 1)) for i in range(30)] + [("u", 1, 0.5)]
    df = spark.createDataFrame(rows, "term string, document long, score double")
    assert [r.document for r in S.ordered_scores(df, "t", 3).collect()] == [0, 1, 2]
    left = S.pruned_scores(df, 2, 0.5)
    assert set(left.columns) == {"term", "document", "score"} and 2 <= left.where("term = 't'").count() < 30


@pytest.mark.parametrize("name", ["pre_wiki", "pre_chain"])
def test_texts_without_words_equal_the_sql(spark, tmp_path, name):
    import duckdb
    from conceptile.catalog import QUERIES, SQL

    texts = ["", "!!! ...", None, " ", "\x00", "a\x00b", "a\r\nb", "[[x]]", "́", "ab", "-- a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r.doc_id: r.text for r in QUERIES[name](spark, str(tmp_path)).collect()} == dict(con.sql(SQL[name]).fetchall())
