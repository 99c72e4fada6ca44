import zlib
from collections import Counter

import numpy as np
import pytest
from conceptile.llm.language import Model, identify, op8_language, svm, train, vector
from pyspark.sql import functions as F


def test_held_out_accuracy_and_folds(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op8_language(spark, d).collect()
    assert {r.doc_id for r in got} == set(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.98 * len(held)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_whole_texts_count_and_pieces_join():
    long = "ein kleiner Satz " * 90_000
    assert abs(float(vector(long) @ vector("ein kleiner Satz " * 50)) - 1) < 0.01
    assert abs(float(vector("un mot " * 1000 + "zwei worte " * 200_000) @ vector("zwei worte " * 50))) > 0.95


def test_family_first_then_pairs():
    texts = {"en": "the thing that was with them", "de": "und der nicht auch für eine", "fr": "les nous avez être où ça", "es": "los ñandú más cómo está el", "xx": "qqq zzz kkk"}
    langs = [lang for lang in texts for _ in range(5)]
    model = Model(np.array([vector(texts[lang]) for lang in langs]), langs)
    assert model.members == {"germanic": ["de", "en"], "own:xx": ["xx"], "romance": ["es", "fr"]} and set(model.by_pair) == {("de", "en"), ("es", "fr")}
    assert all(model.predict(t)[0] == lang for lang, t in texts.items())


def test_defined_cases(spark, docs):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(30)] + [(30 + i, "le chat et le chien", "fr", "s") for i in range(30)]
    odd = [(None, "le chat", "fr", None), (100, None, "en", None), (101, "12 -- 34", "fr", None), (102, "", None, None), (102, "the dog " * 100_000, None, None), (102, "the dog " * 100_000, None, None)]
    df = docs(rows + odd, ["lang_pred", "h", "rank"])
    got = identify(df, train(df, per_language=10)).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in got if r.doc_id is None or r.doc_id >= 100) == Counter({(None, "fr"): 1, (100, "und"): 1, (101, "und"): 1, (102, "und"): 1, (102, "en"): 2})
    assert all(r.lang_pred == ("en" if r.doc_id < 30 else "fr") for r in got if r.doc_id is not None and r.doc_id < 60)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(none, train(none)).collect()} == {"und"}
    one = df.where("lang = 'en'")
    assert {(r.lang_pred, r.score) for r in identify(one, train(one)).collect()} == {("en", 1.0), ("und", 0.0)}
    assert identify(docs([]), train(docs([]))).collect() == []


def test_a_repeated_id_keeps_the_bound(spark, docs):
    df = docs([(4, f"the text {i}", "en", "s") for i in range(500)] + [(9, "le texte", "fr", "s")])
    assert len(train(df, per_language=20).langs) == 2


def test_numbers_and_signs_are_no_letters(spark, docs):
    from conceptile.llm.language import has_letter

    assert not any(map(has_letter, ["²½", "Ⅷ 12", "①", "_", "٣", "", "…"])) and all(map(has_letter, ["²a", "ª", "漢", "ʰ", "Ⅷé"]))
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the cat is here", "en"), ("le chat est la", "fr")] * 20)] + [(100, "½ ²", None, None)]
    got = {r.doc_id: r for r in identify(docs(rows), train(docs(rows))).collect()}
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0)


def plain_vector(text):
    """N-grams counted one by one over the text as one piece."""
    from conceptile.llm.language import _MIX, BITS, GRAMS

    letters = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in text.lower().encode())
    s = " " + letters + " "
    while "  " in s:
        s = s.replace("  ", " ")
    counts = [0] * (1 << BITS)
    for n in range(1, GRAMS + 1):
        for i in range(len(s) - n + 1):
            code = sum(ord(c) << (8 * k) for k, c in enumerate(s[i : i + n]))
            counts[((code + n * int(_MIX[GRAMS])) * int(_MIX[n]) % 2**64) >> (64 - BITS)] += 1
    whole = sum(counts) ** 0.5
    return [c**0.5 / whole for c in counts]


def test_pieces_do_not_change_a_vector(monkeypatch):
    import conceptile.llm.language as language

    texts = ["", "a", "Ab   cd..  é  x", "  two   words  ", "no spaces at the seams" * 3, "x     " * 9]
    for size in (1, 2, 3, 5, 1 << 20):
        monkeypatch.setattr(language, "PIECE", size)
        for t in texts:
            assert language.vector(t).tolist() == pytest.approx(plain_vector(t), abs=1e-6)


def test_whole_table_against_plain_loops(spark, sf_dir):
    """Vectors, margins, families and votes, one by one and by name, from the weights that were learned."""
    from conceptile.llm.language import FAMILIES, op8_language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    family = {lang: f for f, members in FAMILIES.items() for lang in members}
    dot = lambda w, v: sum(float(a) * b for a, b in zip(w, v, strict=True))
    got = {r.doc_id: r for r in op8_language(spark, sf_dir).collect()}
    for r in docs.collect()[::4]:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = [*plain_vector(r.text), 1.0]
        margins = {f: dot(w, v) for f, w in model.by_family.items()}
        first = max(margins, key=margins.get)
        members = [x for x in model.langs if family.get(x, f"own:{x}") == first]
        wins, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), w in model.by_pair.items():
            if a in members:
                m = dot(w, v)
                wins[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        near = min([abs(m) for m in margins.values()] + [abs(x) for x in sums.values() if x], default=1)
        assert near < 1e-4 or got[r.doc_id].lang_pred == max(members, key=lambda x: (wins[x], sums[x]))
