"""Dumps of several bz2 streams in one file, as a data source: read in parallel from any byte, written as streams with an index.

Each bz2 stream stands alone, so that a file is cut into ranges of bytes, and a task decompresses the streams that begin in its range;
a record belongs to the range in which the stream begins that its start tag is in, and may end in a later one. The index (lines of
offset:id:title beside the file, as dumps have it) says in which stream a title is, so that a look-up reads one stream.

Options: ``recordTag`` (page), ``tags`` (title,text): the columns, elements whose text is taken, the last of several; ``includeTags``
(onlyinclude,noinclude,includeonly): elements inside the text that are written out again as tags, where all others leave only their
text; ``splitBytes``; ``stream``: only the stream that begins there; for writing ``recordsPerStream`` (100). Columns are strings, null where a
record has no such element, and ``stream``, the offset of the stream that the record begins in.
"""

from __future__ import annotations

import bz2
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..shipping import ship

#: fixed values: how a bz2 stream begins (level and first block)
STREAM = re.compile(rb"BZh[1-9]\x31\x41\x59\x26\x53\x59")
BEGIN = 10
CHUNK, SPLIT = 1 << 18, 1 << 25
SUFFIX, INDEX = ".xml.bz2", "-index.txt"
#: fixed values: characters that XML 1.0 can't hold
UNFIT = re.compile("[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")


@dataclass
class Range(InputPartition):
    """Of a file, the streams that begin in [start, end)."""

    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """The dump files of a folder, or the one file, with their sizes."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    return sorted((prefix + f.path, f.size) for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(SUFFIX))


def first_stream(file, start: int, end: int) -> int | None:
    """Where the first stream of the range begins."""
    at = start
    while at < end:
        file.seek(at)
        found = STREAM.search(file.read(min(CHUNK, end - at) + BEGIN - 1))
        if found:
            return at + found.start() if at + found.start() < end else None
        at += CHUNK
    return None


def stream_text(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset of the stream, a part of its text), from one stream's beginning to the end of the file; the first part of each is empty, and
    comes before anything of the stream is decompressed."""
    file.seek(start)
    at, left = start, b""
    while left := left or file.read(CHUNK):
        yield at, b""
        unzip, read = bz2.BZ2Decompressor(), 0
        while not unzip.eof:
            data, left = left or file.read(CHUNK), b""
            if not data:
                raise EOFError(f"the stream at {at} is cut off")
            read += len(data)
            text = unzip.decompress(data)
            if text:
                yield at, text
        left = unzip.unused_data
        at += read - len(left)


def raw_records(parts: Iterator[tuple[int, bytes]], tag: str, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset of its stream, record) for records that begin in streams before ``end``; what stands between records is skipped."""
    opens, closes = re.compile(rb"<" + tag.encode() + rb"(?=[\s>])"), b"</" + tag.encode() + b">"
    longest = len(tag) + 2
    held, marks, begun, looked = bytearray(), [], -1, 0  # marks: (place in held, stream)

    def stream(place: int) -> int:
        return next(s for p, s in reversed(marks) if p <= place)

    for at, text in parts:
        if not marks or marks[-1][1] != at:
            if at >= end and begun < 0 and not opens.search(held):
                tail = held[-longest:]
                if not any(tail[i:] == (b"<" + tag.encode())[: len(tail) - i] for i in range(len(tail))):
                    return
            marks.append((len(held), at))
        held += text
        while True:
            if begun < 0:
                found = opens.search(held)
                if not found:
                    keep = max(0, len(held) - longest)
                    break
                begun, looked = found.start(), found.end()
                if stream(begun) >= end:
                    return
            stop = held.find(closes, looked)
            if stop < 0:
                keep, looked = begun, max(looked, len(held) - len(closes))
                break
            stop += len(closes)
            yield stream(begun), bytes(held[begun:stop])
            marks = [(max(0, p - stop), s) for i, (p, s) in enumerate(marks) if i + 1 == len(marks) or marks[i + 1][0] > stop]
            del held[:stop]
            begun, looked = -1, 0
        marks = [(max(0, p - keep), s) for i, (p, s) in enumerate(marks) if i + 1 == len(marks) or marks[i + 1][0] > keep]
        del held[:keep]
        if begun >= 0:
            begun, looked = 0, looked - keep


def fields(record: bytes, tags: frozenset[str], include: frozenset[str]) -> dict[str, str]:
    """The text of the allowed elements of a record."""
    out, parts, current, depth = {}, None, None, 0

    def start(name: str, _: dict) -> None:
        nonlocal parts, current, depth
        depth += 1
        if depth > 1 and name in tags:
            parts, current = [], name
        elif current == "text" and name in include:
            parts.append(f"<{name}>")

    def end(name: str) -> None:
        nonlocal current, depth
        depth -= 1
        if depth > 0 and name in tags and current is not None:
            out[current], current = "".join(parts), None
        elif current == "text" and name in include:
            parts.append(f"</{name}>")

    def said(text: str) -> None:
        if current is not None:
            parts.append(text)

    parser = expat.ParserCreate("UTF-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    parser.Parse(record, True)
    return out


class MultistreamDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multistream"

    def names(self, option: str, default: str) -> list[str]:
        return [x.strip() for x in self.options.get(option, default).split(",") if x.strip()]

    def schema(self) -> T.StructType:
        return T.StructType([*[T.StructField(t, T.StringType()) for t in self.names("tags", "title,text")], T.StructField("stream", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        tags = self.names("tags", "title,text")
        stream = self.options.get("stream")
        return DumpReader(self.options["path"], self.options.get("recordTag", "page"), tags, self.names("includeTags", "onlyinclude,noinclude,includeonly"), int(self.options.get("splitBytes", SPLIT)), None if stream is None else int(stream))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return DumpWriter(self.options["path"], self.options.get("recordTag", "page"), [f.name for f in schema.fields], int(self.options.get("recordsPerStream", 100)))


class DumpReader(DataSourceReader):
    def __init__(self, path: str, record: str, tags: list[str], include: list[str], split: int, stream: int | None):
        self.path, self.record, self.tags, self.include, self.split, self.stream = path, record, tags, frozenset(include), split, stream

    def partitions(self) -> list[Range]:
        if self.stream is not None:
            return [Range(self.path, self.stream, self.stream + 1)]
        return [Range(p, at, min(at + self.split, size)) for p, size in files(self.path) for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        store, at = opened(partition.path)
        wanted = frozenset(self.tags)
        with store.open_input_file(at) as file:
            start = first_stream(file, partition.start, partition.end)
            if start is None:
                return
            for stream, record in raw_records(stream_text(file, start), self.record, partition.end):
                found = fields(record, wanted, self.include)
                yield (*[found.get(t) for t in self.tags], stream)


@dataclass
class Part(WriterCommitMessage):
    temporary: str
    name: str


class DumpWriter(DataSourceWriter):
    """A file of streams and its index for each task, moved to their places when all are written."""

    def __init__(self, path: str, record: str, columns: list[str], per_stream: int):
        self.path, self.record, self.columns, self.per_stream = path, record, columns, per_stream
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        store, root = opened(self.path)
        temporary, name = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}", f"part-{uuid.uuid4().hex}-multistream"
        store.create_dir(temporary)
        at, held, index, n = 0, io.StringIO(), [], 0
        with store.open_output_stream(f"{temporary}/{name}{SUFFIX}", compression=None) as out:

            def flush(text: str) -> int:
                data = bz2.compress(text.encode())
                out.write(data)
                return len(data)

            at += flush("<mediawiki>\n")
            for row in rows:
                cells = "".join(f"<{c}>{escape(UNFIT.sub("", str(row[c])), {chr(13): "&#13;"})}</{c}>" for c in self.columns if row[c] is not None)
                held.write(f"<{self.record}>{cells}</{self.record}>\n")
                n += 1
                index.append(f"{at}:{n}:{UNFIT.sub('', row['title'] or '') if 'title' in self.columns else ''}\n".replace("\n", " ").strip() + "\n")
                if n % self.per_stream == 0:
                    at += flush(held.getvalue())
                    held = io.StringIO()
            if held.tell():
                at += flush(held.getvalue())
            flush("</mediawiki>\n")
        with store.open_output_stream(f"{temporary}/{name}{INDEX}", compression=None) as out:
            out.write("".join(index).encode())
        return Part(temporary, name)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m:
                for suffix in (SUFFIX, INDEX):
                    store.move(f"{m.temporary}/{m.name}{suffix}", f"{root}/{m.name}{suffix}")
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary-{self.job}")


def registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MultistreamDump)


def read_dump(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The records of a dump file, or of the dump files of a folder."""
    registered(spark)
    return spark.read.format("multistream").options(**options).load(path)


def write_dump(df: DataFrame, path: str, **options: str | int) -> None:
    """Appends the rows as dump files with their indexes; text is escaped, without characters that XML can't hold; columns are elements,
    null ones are left out."""
    registered(df.sparkSession)
    df.write.format("multistream").options(**options).mode("append").save(path)


def dump_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, id, title) of an index file beside its dump (bz2 too), or of those of a folder."""
    found = re.search(rf"{re.escape(INDEX)}(\.bz2)?$", path)
    reader = spark.read if found else spark.read.option("pathGlobFilter", f"*{INDEX}*")
    take = lambda i: F.regexp_extract("value", r"^(\d+):(\d+):(.*)$", i)
    file = F.concat(F.regexp_replace(F.col("_metadata.file_path"), rf"{re.escape(INDEX)}(\.bz2)?$", ""), F.lit(SUFFIX))
    return reader.text(path).select("value", file.alias("file")).where("value rlike '^[0-9]+:[0-9]+:'").select("file", take(1).cast("long").alias("offset"), take(2).cast("long").alias("id"), take(3).alias("title"))


def find_in_dump(spark: SparkSession, path: str, title: str, index: str | None = None, **options: str | int) -> DataFrame:
    """The records of this title: the index names their streams, and only those are read."""
    streams = dump_index(spark, index or path).where(F.col("title") == title).select("file", "offset").distinct().collect()
    out = read_dump(spark, "", **options).limit(0) if not streams else None
    for s in streams:
        one = read_dump(spark, s.file, **(options | {"stream": s.offset})).where(F.col("title") == title)
        out = one if out is None else out.unionByName(one)
    return out
