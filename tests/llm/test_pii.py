import hashlib
import re

from conceptile.llm.pii import KINDS, base_spans, document_counts, emails, h64, ips, joined, luhn, op2_sanitised, sanitise, scanned, terms
from conceptile.llm.common import LONG, Scratch, schema
from hypothesis import given, settings
from hypothesis import strategies as st

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return joined(sorted(out, key=lambda s: (s[0], KINDS.index(s[1]))))


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@1 %_-2é+()", max_size=60))
def test_scanners_equal_the_patterns(text):
    assert list(emails(text)) == [m.span() for m in EMAIL.finditer(text)]
    assert list(ips(text)) == [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert joined(base_spans(text)) == brute(text)


def test_whole_table_against_the_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_sanitised(spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r.n_email for r in got)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in KINDS[:4]]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_terms_that_reveal_an_entity_go(spark, docs):
    """zorblat is only where the address is; mostly there is nearly so; common words are everywhere."""
    held = [(i, f"the zorblat mostly wrote from ann@x.org number {'abcdefghij'[i]}uvw and more") for i in range(8)]
    rest = [(100 + i, f"the common words and more {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}xyz" + (" mostly" if i < 3 else "")) for i in range(90)]
    got = {r.doc_id: r for r in sanitise(docs(held + rest, ["row", "spans"])).collect()}
    for i, t in held:
        kinds = {t[int(a) : int(b)]: k for k, a, b in (x.split(":") for x in got[i].spans.split(","))}
        assert kinds["zorblat"] == "remove" and kinds["mostly"] == "generalise" and kinds["ann@x.org"] == "email" and "the" not in kinds
        assert got[i].sanitised.startswith("the  <TERM>") and "<EMAIL>" in got[i].sanitised
    assert all(got[i].spans == "" and got[i].sanitised is None for i, _ in rest)


def test_counts_go_over_all_documents_in_blocks(spark, docs, monkeypatch):
    import conceptile.llm.pii as pii

    monkeypatch.setattr(pii, "BLOCK", 2)
    wanted = spark.createDataFrame([(h64(w),) for w in ("aaa", "bbb", "ccc", "ddd", "eee")], schema(term=LONG))
    df = docs([(1, "AAA bbb aaa"), (2, "bbb ddd"), (3, None), (4, "zzz")])
    assert {r.term: r.c for r in document_counts(df, wanted, Scratch(spark)).collect()} == {h64("aaa"): 1, h64("bbb"): 2, h64("ddd"): 1}


def test_defined_cases(spark, docs):
    card = "4111 1111 1111 1111"
    rows = [(1, None), (2, ""), (3, f"é {card} a@b.co 1.2.3.4 +1 (222) 333-4444"), (3, f"é {card} a@b.co 1.2.3.4 +1 (222) 333-4444"), (None, "x@" * 50_000 + "9" * 50_000), (6, "4111 1111 1111 1112 999.1.1.1")]
    got = sanitise(docs(rows, ["text_hash", "entities", "n_ip"])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256 == empty) for r in got) == [(0, 0, 0, 0, 0, True), (1, 0, 0, 0, 0, True), (2, 0, 0, 0, 0, True), (3, 1, 1, 1, 1, False), (3, 1, 1, 1, 1, False), (6, 0, 0, 0, 0, True)]
    assert sanitise(docs([])).collect() == [] and list(terms("ab abc", [])) == [("abc", 3, 6)] and scanned(docs([])).count() == 0


def test_an_entity_of_one_text_is_protected_and_copies_count_once(spark, docs):
    """Most personal data is in one text only; here one with three copies, and an address of two texts."""
    own = "the quexil wrote from bob@x.org and more"
    held = [(i, own) for i in range(3)] + [(3, "the vontar said eve@x.org and more"), (4, "the vontar met eve@x.org and more often")]
    rest = [(100 + i, f"the common words and more {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}xyz" + " wrote said met"[: 6 * (i % 2)]) for i in range(90)]
    got = {r.doc_id: r for r in sanitise(docs(held + rest)).collect()}
    for i, t in held:
        kinds = {t[int(a) : int(b)]: k for k, a, b in (x.split(":") for x in got[i].spans.split(","))}
        assert kinds["quexil" if i < 3 else "vontar"] == "remove" and kinds[t.split("@")[0][-3:] + "@x.org"] == "email" and not {"the", "and", "more"} & set(kinds)
    assert all(got[i].sanitised is None for i, _ in rest)


def test_counts_take_copies_once(spark, docs):
    wanted = spark.createDataFrame([(h64(w),) for w in ("aaa", "bbb")], schema(term=LONG))
    df = docs([(i, "aaa bbb") for i in range(7)] + [(8, "bbb ccc"), (9, None), (10, None)])
    assert {r.term: r.c for r in document_counts(df, wanted, Scratch(spark)).collect()} == {h64("aaa"): 1, h64("bbb"): 2}


def test_numbers_dates_and_short_names_are_terms(spark, docs):
    found = [w for w, _, _ in terms("Li 王五 met user_7x on 2021-03-04, customer 4711 re a.b of it", [])]
    assert found == ["li", "王五", "met", "user_7x", "2021-03-04", "customer", "4711"]
    text = "see host/1.2.3.4 and 1.2.3.4x"
    assert [w for w, _, _ in terms(text, base_spans(text))] == ["see", "host", "and"]
    held = [(1, "the Li with 4711-x of 2021-03-04 has ann@x.org and more")]
    rest = [(100 + i, f"the common words and more {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}xyz has with of") for i in range(90)]
    got = {r.doc_id: r for r in sanitise(docs(held + rest)).collect()}
    assert got[1].sanitised == "the  with  of  has <EMAIL> and more"


@settings(max_examples=300, deadline=None)
@given(st.text("abA1 .-_@é王", max_size=40))
def test_both_ways_to_terms_are_one(text):
    from conceptile.llm.pii import distinct_terms

    assert distinct_terms(text) == {w for w, _, _ in terms(text, base_spans(text))}


def test_whole_table_against_an_independent_estimate(spark, sf_dir):
    """Every span of every document, from plain sets of texts: PMI by counting, terms by their characters."""
    from math import log

    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]

    def parts(text):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute(text).split(",") if x)]
        named = {(k, text[a:b].lower() if k in ("email", "ip") else "".join(c for c in text[a:b] if c in "0123456789")) for k, a, b in spans}
        taken = {i for _, a, b in spans for i in range(a, b)}
        free = lambda a, b: not any(i in taken for i in range(a, b))
        out = []
        for m in re.finditer(r"[^\W_]+(?:[-_./:][^\W_]+)*", text):
            if any(c.isdecimal() for c in m[0]) and free(*m.span()):
                out.append((m[0].lower(), *m.span()))
            else:
                out += [(r[0].lower(), m.start() + r.start(), m.start() + r.end()) for r in re.finditer(r"[^\W_]{3,}|[^\W_]?[^\W_a-z][^\W_]?", m[0]) if free(m.start() + r.start(), m.start() + r.end())]
        return spans, named, out

    texts = {t: parts(t or "") for t in {t for _, t in docs}}
    n, with_entity, with_term = len(texts), {}, {}
    for t, (_, named, found) in texts.items():
        for e in named:
            with_entity.setdefault(e, set()).add(t)
        for w in {w for w, _, _ in found}:
            with_term.setdefault(w, set()).add(t)
    got, added = {r.doc_id: r.spans for r in op2_sanitised(spark, d).collect()}, 0
    for i, t in docs:
        spans, named, found = texts[t]
        want, unsure = list(spans), set()
        for w, a, b in found:
            shares = []
            for e in named:
                c_e, c_t, both = len(with_entity[e]), len(with_term[w]), len(with_entity[e] & with_term[w])
                shares.append(log(n * both / (c_e * c_t)) / log(n / c_e))
            share = max(shares, default=0)
            if share >= 0.6 - 1e-9:
                want.append(("remove" if share >= 0.9 - 1e-9 else "generalise", a, b))
                if min(abs(share - 0.6), abs(share - 0.9)) < 1e-9:
                    unsure.add((a, b))
        want.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        sure = lambda s: [x for x in s if x and tuple(map(int, x.split(":")[1:])) not in unsure]
        assert sure(got[i].split(",")) == sure([f"{k}:{a}:{b}" for k, a, b in want])
        added += len(want) - len(spans)
    assert added > 100
