"""Members of archives as rows, and their records as streams.

Listing reads only the directory at a zip's end. The members found are dealt to tasks by size, and each task opens its
archives where they lie (any file system that Arrow knows), seeks to a member and inflates it piece by piece. Gzip, and tar
under it, can't be entered in the middle: such a file is one task's, and a stream too.
"""

from __future__ import annotations

import codecs
import gzip
import json
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import IO, Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
BROKEN = (ValueError, OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error)
_LISTED = "file string, member long, name string, how string, size long"
_LISTING = re.compile(r'\{\s*"Records"\s*:\s*\[')


def opened(path: str) -> pa.NativeFile:
    """A file for random access, by path or URI."""
    if re.match(r"file:/+", path) or "://" not in path:
        where, name = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
        if path.startswith("file:"):
            from urllib.parse import unquote

            name = unquote(name)
    else:
        where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _skipped(name: str) -> bool:
    return name.endswith("/") or "__MACOSX" in name


def members(spark: SparkSession, paths: str | list[str], glob: str = "*", skip_broken: bool = False) -> DataFrame:
    """file, member (its number in the file), name, how (zip, tar, gzip or plain), size: what is to be read, one row for each member of a zip."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _LISTED.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with opened(path) as f:
                        head = f.read(2)
                        if head == b"PK":
                            with zipfile.ZipFile(f) as z:
                                rows = [(path, i, m.filename, "zip", m.file_size) for i, m in enumerate(z.infolist()) if not _skipped(m.filename)]
                        else:
                            how = "tar" if path.endswith((".tar.gz", ".tgz")) else "gzip" if head == b"\x1f\x8b" else "plain"
                            rows = [(path, 0, path, how, length)]
                except BROKEN:
                    if not skip_broken:
                        raise
                    continue
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return found.select("path", "length").mapInArrow(work, _LISTED)  # content isn't selected, so it isn't read


class Scanner:
    """JSON values one after the other from pieces of text; of the text no more is kept than the value at hand needs."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self._pieces, self._text, self._at, self._ended = iter(pieces), "", 0, False
        self._decoder = json.JSONDecoder()

    def _more(self, least: int = 1) -> None:
        """Takes more text, as much again as there is, so that a long value isn't tried too often."""
        held = [self._text[self._at :]]
        wanted, got = max(least, len(held[0])), 0
        while got < wanted and not self._ended:
            piece = next(self._pieces, None)
            self._ended = piece is None
            held.append(piece or "")
            got += len(held[-1])
        self._text, self._at = "".join(held), 0

    def peek(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while True:
            while self._at < len(self._text) and self._text[self._at].isspace():
                self._at += 1
            if self._at < len(self._text):
                return self._text[self._at]
            if self._ended:
                return ""
            self._more()

    def take(self, wanted: str) -> str:
        """Takes the next character, which must be one of these."""
        c = self.peek()
        if not c or c not in wanted:
            raise ValueError(f"{c or 'the end'} where one of {wanted} should be")
        self._at += 1
        return c

    def value(self) -> Any:
        self.peek()
        while True:
            try:
                found, end = self._decoder.raw_decode(self._text, self._at)
            except json.JSONDecodeError:
                if self._ended:
                    raise
            else:
                if end < len(self._text) or self._ended or isinstance(found, (dict, list, str)):  # a number may go on
                    self._at = end
                    return found
            self._more()

    def values(self) -> Iterator[Any]:
        """The values of an array whose bracket was taken."""
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return

    def listing(self) -> bool:
        """Whether an object follows whose first key is Records, a list; if so its beginning is taken."""
        if len(self._text) - self._at < 256 and not self._ended:
            self._more(256)
        if m := _LISTING.match(self._text, self._at):
            self._at = m.end()
        return m is not None

    def rest_of_object(self) -> dict[str, Any]:
        """The other keys of an object, up to its end."""
        out = {}
        while self.take(",}") == ",":
            key = self.value()
            self.take(":")
            out[key] = self.value()
        return out


def objects(text: str | Iterable[str]) -> Iterator[dict]:
    """Objects in a text of JSON documents one after the other; arrays are opened, other values dropped, and malformed text raises."""
    scanner = Scanner([text] if isinstance(text, str) else text)
    while c := scanner.peek():
        if c == "[":
            scanner.take("[")
            yield from (x for x in scanner.values() if isinstance(x, dict))
        elif isinstance(x := scanner.value(), dict):
            yield x


def json_records(pieces: Iterable[str]) -> Iterator[str]:
    """The objects of a JSON text as texts; one with a list of Records gives these instead, one by one if the list stands first."""
    scanner = Scanner(pieces)

    def opened_up(x: Any) -> Iterator[Any]:
        if isinstance(x, dict):
            yield from x["Records"] if isinstance(x.get("Records"), list) else [x]

    while c := scanner.peek():
        if c == "{" and scanner.listing():
            for x in scanner.values():
                yield json.dumps(x)
            scanner.rest_of_object()
            continue
        if c == "[":
            scanner.take("[")
            found: Iterable[Any] = scanner.values()
        else:
            found = [scanner.value()]
        for x in found:
            for y in opened_up(x):
                yield json.dumps(y)


def _pieces(raw: IO[bytes]) -> Iterator[str]:
    decode = codecs.getincrementaldecoder("utf-8")("replace")
    while data := raw.read(CHUNK):
        yield decode.decode(data)
    yield decode.decode(b"", final=True)


def _lines(pieces: Iterable[str]) -> Iterator[str]:
    held: list[str] = []
    for piece in pieces:
        *whole, last = piece.split("\n")
        for x in whole:
            yield "".join([*held, x]).removesuffix("\r")
            held = []
        held.append(last)
    if last := "".join(held):
        yield last.removesuffix("\r")


def member_records(name: str, raw: IO[bytes]) -> Iterator[tuple[str, str]]:
    """What a member holds: lines of a log (told by its suffix, or by how it begins), or JSON records."""
    pieces, head = _pieces(raw), []
    while len("".join(head).lstrip()) < 8:  # one piece, unless it is blank
        if (piece := next(pieces, None)) is None:
            break
        head.append(piece)
    start = "".join(head).lstrip()
    whole = (x for part in (head, pieces) for x in part)
    if name.endswith((".log", ".txt")) or start.startswith(("<Event", "type=")):
        yield from (("line", x) for x in _lines(whole))
    else:
        yield from (("json", x) for x in json_records(whole))


def _streams(f: IO[bytes], how: str, name: str, member: int, archive: zipfile.ZipFile | None) -> Iterator[tuple[int, str, IO[bytes]]]:
    if archive is not None:
        with archive.open(archive.infolist()[member]) as raw:
            yield member, name, raw
    elif how == "tar":
        with tarfile.open(fileobj=f, mode="r|gz") as t:
            for i, m in enumerate(t):
                if m.isfile() and not _skipped(m.name):
                    yield i, m.name, t.extractfile(m)
    else:
        yield 0, name, gzip.GzipFile(fileobj=f) if how == "gzip" else f


def _read(row: dict[str, Any], skip_broken: bool, zips: dict[str, zipfile.ZipFile]) -> Iterator[tuple[int, str, str]]:
    """(member, kind, value) of a row of `members`. Passing a broken one over as a whole needs reading it twice."""
    path, how, n = row["file"], row["how"], row["member"]

    def once(check: bool = False) -> Iterator[tuple[int, str, str]]:
        if how == "zip":
            if path not in zips:  # members of one archive follow each other: one directory is kept
                for old in zips.values():
                    old.fp.close()
                zips.clear()
                zips[path] = zipfile.ZipFile(opened(path))
            for i, name, raw in _streams(zips[path].fp, how, row["name"], n, zips[path]):
                yield from ((i, *r) for r in member_records(name, raw))
            return
        with opened(path) as f:
            for i, name, raw in _streams(f, how, row["name"], n, None):
                yield from ((i, *r) for r in member_records(name, raw))

    if skip_broken:
        try:
            for _ in once():
                pass
        except BROKEN:
            return
    yield from once()


def records(listed: DataFrame, skip_broken: bool = False, task_bytes: int = 128 << 20) -> DataFrame:
    """file, member, kind (line or json), value: the records of `members`, which are dealt to tasks by their number and size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zips: dict[str, zipfile.ZipFile] = {}
        for b in batches:
            for row in b.to_pylist():
                held: list[tuple[int, str, str]] = []
                size = 0
                for r in _read(row, skip_broken, zips):
                    held.append(r)
                    size += len(r[2])
                    if size >= CHUNK or len(held) >= 10_000:
                        yield _batch(row["file"], held)
                        held, size = [], 0
                if held:
                    yield _batch(row["file"], held)

    n, size = listed.agg(F.count("*"), F.sum("size")).first()
    parts = max(1, min(n, max(listed.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // task_bytes))))
    dealt = listed.repartition(parts, "file", "member").sortWithinPartitions("file", "member")
    return dealt.mapInArrow(work, "file string, member long, kind string, value string")


def _batch(path: str, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    member, kind, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(member, pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string())], ["file", "member", "kind", "value"])
