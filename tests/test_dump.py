"""Multistream dumps: every record once whatever the ranges, tags inside texts, and look-ups that read one stream."""

import bz2
import random
import re

import pytest
from conceptile.sources import dump as D
from pyspark.sql import functions as F

RECORDS = [
    "<page><title>A &amp; b</title><redirect title='x'/><revision><text bytes='3'>one <onlyinclude>two &lt;b&gt;</onlyinclude><i>three</i></text></revision></page>",
    "<page>\n<title>Ü</title><text></text></page>",
    "<page><title>no text</title></page>",
    "<page><title>first</title><title>last</title><text>x<noinclude>y<pages>z</pages></noinclude></text></page>",
] + [f"<page><title>T{i}</title><id>{i}</id><text>{'é word ' * (i % 7)}{i}</text></page>" for i in range(60)]
WANT = [("A & b", "one <onlyinclude>two <b></onlyinclude>three"), ("Ü", ""), ("no text", None), ("last", "x<noinclude>yz</noinclude>")] + [(f"T{i}", "é word " * (i % 7) + str(i)) for i in range(60)]


def dumped(tmp_path, cuts, name="d"):
    """The records as one text, cut into streams at these places."""
    text = ("<mediawiki>\n<siteinfo>x</siteinfo>\n" + "\n".join(RECORDS) + "\n</mediawiki>").encode()
    places = [0, *sorted({c % len(text) for c in cuts} - {0}), len(text)]
    path = tmp_path / f"{name}.xml.bz2"
    path.write_bytes(b"".join(bz2.compress(text[a:b]) for a, b in zip(places, places[1:], strict=False)))
    return str(path)


def read(path, split):
    reader = D.DumpReader(path, "page", ["title", "text"], ["onlyinclude", "noinclude"], split, None)
    parts = [list(reader.read(p)) for p in reader.partitions()]
    return parts, [r[:2] for rows in parts for r in rows]


@pytest.mark.parametrize("split", [1, 40, 300, 1 << 20])
@pytest.mark.parametrize("streams", [1, 2, 9, 70])
def test_every_record_once_whatever_the_ranges(tmp_path, split, streams):
    """Streams end anywhere: in tags, in letters, between records."""
    path = dumped(tmp_path, random.Random(streams).choices(range(10**6), k=streams - 1))
    parts, rows = read(path, split)
    assert rows == WANT
    assert sum(bool(p) for p in parts) > 1 or streams == 1 or split > 300


def test_all_cuts_of_a_tag(tmp_path):
    text = "<mediawiki>" + "".join(RECORDS[:3])
    at = text.index("<page>", 20)
    for k in range(8):
        b = text.encode()
        path = tmp_path / f"{k}.xml.bz2"
        path.write_bytes(bz2.compress(b[: at + k]) + bz2.compress(b[at + k :]))
        assert read(str(path), 30)[1] == WANT[:3]


def test_a_stream_that_is_cut_off_is_an_error(tmp_path):
    path = tmp_path / "x.xml.bz2"
    path.write_bytes(bz2.compress(b"<page><title>a</title></page>") + bz2.compress(b"<page><title>b</title></page>" * 50)[:-9])
    with pytest.raises(EOFError):
        read(str(path), 1 << 20)


def test_source_over_spark(spark, tmp_path):
    path = dumped(tmp_path, [900, 1500, 2500, 3000])
    df = D.read_dump(spark, path, splitBytes=200, includeTags="onlyinclude,noinclude")
    assert df.columns == ["title", "text", "stream"] and df.rdd.getNumPartitions() > 1
    assert sorted(tuple(r)[:2] for r in df.collect() if r.text is not None) == sorted(w for w in WANT if w[1] is not None)
    assert df.select("stream").distinct().count() > 1
    other = D.read_dump(spark, path, tags="title,id", includeTags="")
    assert other.where("id = '7'").first().title == "T7"


def test_written_dumps_come_back_and_titles_read_one_stream(spark, tmp_path):
    rows = [(f"P {i}", None if i % 9 == 0 else f"a <b> & [[c|{i}]] \r\n é \x01") for i in range(250)]
    out = f"file://{tmp_path}/dump"
    D.write_dump(spark.createDataFrame(rows, "title string, text string").repartition(3), out, recordsPerStream=10)
    assert {tuple(r) for r in D.read_dump(spark, out, splitBytes=300).select("title", "text").collect()} == {(t, x and x.replace("\x01", "")) for t, x in rows}
    index = D.dump_index(spark, out)
    assert index.count() == 250 and index.select("file", "offset").distinct().count() >= 25
    entry = index.where("title = 'P 77'").first()
    assert [r.title for r in D.find_in_dump(spark, out, "P 77").collect()] == ["P 77"]
    assert D.find_in_dump(spark, out, "P 777").collect() == []
    # what lies outside the stream may be broken
    path = re.sub("^file:(//)?", "", entry.file)
    whole = open(path, "rb").read()
    starts = [m.start() for m in D.STREAM.finditer(whole)]
    end = next((s for s in starts if s > entry.offset), len(whole))
    with open(path, "wb") as f:
        f.write(b"?" * entry.offset + whole[entry.offset : end] + b"?" * (len(whole) - end))
    assert [(r.title, r.stream) for r in D.find_in_dump(spark, out, "P 77").collect()] == [("P 77", entry.offset)]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert D.read_dump(spark, str(tmp_path / "none")).count() == 0
    D.write_dump(spark.createDataFrame([], "title string, text string"), f"{tmp_path}/empty")
    assert D.read_dump(spark, f"{tmp_path}/empty").count() == 0
