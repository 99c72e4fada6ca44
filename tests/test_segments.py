"""An index that grows equals one that is built at once, after appends, deletions, new versions, failures and compactions."""

import pytest
from conceptile.functions.weights import WeightSpec
from conceptile.operators.index import build_index
from conceptile.operators.segments import Segments

DOCS = [(1, "cat sat mat cat"), (2, "dog sat log"), (3, "cat dog bird bird bird"), (4, ""), (5, None), (6, "the cat"), (7, "bird the the")]
SCHEMA = "doc_id long, text string"


def postings(index):
    return {(r.doc_id, r.term): round(r.score, 9) for r in index.postings.collect()}, {r.term: r.df for r in index.df.collect()}, tuple(round(x, 9) for x in index.stats.first())


@pytest.fixture()
def grown(spark, tmp_path):
    return Segments(spark, f"file://{tmp_path}/index")


def whole(spark, rows, mode="ltc"):
    return postings(build_index(spark.createDataFrame(rows, SCHEMA), weights=WeightSpec(mode)))


@pytest.mark.parametrize("mode", ["ltc", "Lpb"])
def test_appends_equal_one_build(spark, grown, mode):
    for i, part in enumerate((DOCS[:3], DOCS[3:6], DOCS[6:])):
        assert grown.append(spark.createDataFrame(part, SCHEMA), f"b{i}")
    assert postings(grown.index(WeightSpec(mode))) == whole(spark, DOCS, mode)


def test_a_failed_batch_is_run_again_and_a_committed_one_is_not(spark, grown, monkeypatch):
    grown.append(spark.createDataFrame(DOCS[:3], SCHEMA), "a")
    with monkeypatch.context() as m:  # ends after its tables, before its commit
        m.setattr(Segments, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            grown.append(spark.createDataFrame([(8, "half a batch"), (9, "x")], SCHEMA), "b")
    assert postings(grown.index()) == whole(spark, DOCS[:3])
    assert grown.append(spark.createDataFrame(DOCS[3:], SCHEMA), "b")
    assert not grown.append(spark.createDataFrame(DOCS[3:], SCHEMA), "b")
    assert postings(grown.index()) == whole(spark, DOCS)


def test_deletions_new_versions_and_compaction(spark, grown):
    grown.append(spark.createDataFrame(DOCS, SCHEMA), "a")
    opened = grown.opened()
    grown.delete(spark.createDataFrame([(2,), (7,), (99,)], "doc_id long"), "d")
    grown.append(spark.createDataFrame([(1, "owl owl"), (7, "back again")], SCHEMA), "b")
    grown.append(spark.createDataFrame([(1, "owl cat")], SCHEMA), "c")
    want = whole(spark, [(1, "owl cat"), *DOCS[2:6], (7, "back again")])
    assert postings(grown.index()) == want
    assert postings(opened.index()) == whole(spark, DOCS)  # what was open stays
    assert grown.compact("m") and not grown.compact("m")
    assert postings(grown.index()) == want and [c.name for c in grown.opened().commits] == ["m"]
    assert sorted(grown.vacuum()) == ["a", "b", "c", "d"] and postings(grown.index()) == want
    grown.delete(spark.createDataFrame([(1,)], "doc_id long"), "e")
    grown.append(spark.createDataFrame([(3, "new")], SCHEMA), "f")
    assert postings(grown.index()) == whole(spark, [(3, "new"), *DOCS[3:6], (7, "back again")])


def test_commits_of_two_writers_and_broken_log_lines(spark, grown, tmp_path):
    grown.append(spark.createDataFrame(DOCS[:2], SCHEMA), "a")
    (tmp_path / "index/log/00000001.json").write_text("")  # created by a writer that died
    grown.append(spark.createDataFrame(DOCS[2:], SCHEMA), "b")
    assert [(c.number, c.name) for c in grown.log()] == [(0, "a"), (2, "b")]
    assert postings(grown.index()) == whole(spark, DOCS)


def test_an_empty_index(spark, grown):
    assert grown.log() == [] and postings(grown.index()) == ({}, {}, (0, 0.0))
    assert not grown.compact("m")
