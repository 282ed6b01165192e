"""Nested JSON manifests in parts: ``{source_id: [file, …]}`` cut into its file objects, wherever a part begins.

A document comes in pieces that each end at a ``}``, as Spark's text reader cuts a file at that separator; a large file is
read by many tasks. Between two file objects the pieces hold a comma, or the end of one source and the name of the next.
A piece that closes no object (a brace inside a string, a nested object) is joined to the next one. A file object that is
no JSON costs itself only: ``,{"`` cannot stand inside a JSON string, so the next object is found again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_FLAT = re.compile(rf'\{{[^"{{}}\[\]]*(?:{_STRING}[^"{{}}\[\]]*)*', re.S)
_TOKEN = re.compile(rf'{_STRING}|["{{}}\[\]]', re.S)
_GLUE = re.compile(rf'\s*(?:(?P<mark>[,:{{\[\]])|(?P<text>{_STRING})|(?P<word>[^\s,:{{}}\[\]"]+))', re.S)
_NEXT_OBJECT = re.compile(rf'(?:,|\]\s*,\s*(?P<source>{_STRING})\s*:\s*\[)\s*(?=\{{\s*")', re.S)
_BORDER = re.compile(rf'\s*(?:,\s*\{{\s*"|\]\s*,\s*{_STRING}\s*:)', re.S)
_AFTER_SOURCE = re.compile(rf'\s*(?:\]\s*$|,\s*{_STRING}\s*:.*{_STRING}\s*:\s*\[\s*\{{\s*"|,\s*{_STRING}\s*:\s*\[\s*\{{)', re.S)
_COLON = re.compile(r"\s*:")
_NEXT_SOURCE = re.compile(r'\s*,\s*"')
#: An object that is not closed within so many characters over several pieces is given up.
LONGEST_JOINED = 1 << 20

# where a piece begins
START, IN_MAP, IN_VALUE, IN_ARRAY, LOST, UNKNOWN = "start", "map", "value", "array", "lost", "unknown"

# problems of elements
NO_OBJECT, NO_ARRAY, UNREADABLE, CUT_OFF, NO_DOCUMENT = (
    "element is no object",
    "source is no array",
    "unreadable",
    "document is cut off",
    "document is no object",
)


class Element(NamedTuple):
    """One file object, or what stands in its place; ``source`` is None where the part does not tell it."""

    source: str | None
    text: str
    problem: str | None


def _scan(text: str) -> tuple[bool, list[str]]:
    """Whether a string is open at the end, and the brackets that are."""
    brackets: list[str] = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == '"':
            return True, brackets
        if token in "{[":
            brackets.append(token)
        elif token in "}]" and brackets:
            brackets.pop()
    return False, brackets


class DocumentSplitter:
    """Takes the pieces of a part of a document in order and yields its elements.

    ``whole`` parts begin with the document. Another part may begin inside a source or an object: its elements have no
    source until one is named, and ``lead`` holds what stands before its first border.
    """

    def __init__(self, whole: bool = True):
        self.source: str | None = None
        self.lead: list[str] = []
        self.open: str | None = None  # an object that no piece has closed yet
        self._state = START if whole else UNKNOWN
        self._held: Element | None = None
        self._name = ""  # a string between two objects that goes on in the next piece

    def piece(self, text: str) -> Iterator[Element]:
        """What a piece completes. The last object is held back until another piece follows: only then was it closed."""
        if self._held is not None:
            yield self._held
            self._held = None
        if self._state == UNKNOWN:
            if not (_BORDER.match(text) or _AFTER_SOURCE.match(text)):
                self.lead.append(text)
                return
            self._state = IN_MAP if _NEXT_SOURCE.match(text) else IN_ARRAY
        if self.open is not None:
            begun, self.open = self.open, None
            if self._is_new(begun, text) or len(begun) + len(text) > LONGEST_JOINED:
                yield Element(self.source, begun, UNREADABLE)
            else:
                yield from self._object(f"{begun}}}{text}")
                return
        if self._name:
            text, self._name = f"{self._name}}}{text}", ""
        yield from self._glue(text)

    def end(self) -> Iterator[Element]:
        """What is left at the end of the document, which ends behind its last object, not in it."""
        if (left := self.left_open() or self._name):
            yield Element(self.source, left, CUT_OFF)

    def left_open(self) -> str | None:
        """The object that the part ends in or with, without its last brace."""
        return self._held.text[:-1] if self._held is not None else self.open

    @staticmethod
    def _is_new(begun: str, text: str) -> bool:
        """Whether a piece at which an object is still open must begin another one."""
        if not _BORDER.match(text):
            return False
        in_string, brackets = _scan(begun + "}")
        return in_string or brackets[-1:] != ["["]

    def _glue(self, text: str) -> Iterator[Element]:
        """Reads up to the next object, which goes on to the end of the piece."""
        at = 0
        while self._state != LOST and (m := _GLUE.match(text, at)):
            mark, before, at = m["mark"], at, m.end()
            if self._state == START:
                if mark != "{":
                    self._state = LOST
                    yield Element(None, text[before:], NO_DOCUMENT)
                self._state = IN_MAP if mark == "{" else LOST
            elif mark == ",":
                continue
            elif self._state == IN_MAP and m["text"] and (colon := _COLON.match(text, at)):
                self.source, self._state, at = _unescaped(m["text"]), IN_VALUE, colon.end()
            elif self._state == IN_VALUE and mark == "[":
                self._state = IN_ARRAY
            elif self._state == IN_ARRAY and mark == "]":
                self._state = IN_MAP
            elif self._state in (IN_VALUE, IN_ARRAY) and mark == "{":
                yield from self._object(text[m.start("mark") :])
                return
            elif self._state in (IN_VALUE, IN_ARRAY) and mark is None:
                yield Element(self.source, m["text"] or m["word"], NO_ARRAY if self._state == IN_VALUE else NO_OBJECT)
                self._state = IN_MAP if self._state == IN_VALUE else IN_ARRAY
            else:
                at = before
                break
        rest = text[at:].strip()
        if rest.startswith('"') and not _BORDER.search(rest) and len(rest) < LONGEST_JOINED:
            self._name = rest
            return
        if rest and self._state != LOST:
            yield Element(self.source, rest, UNREADABLE)
            self._state = IN_ARRAY if self.source is not None else IN_MAP

    def _object(self, text: str) -> Iterator[Element]:
        """``text`` begins an object; its end is a ``}`` that was cut off."""
        if not _FLAT.fullmatch(text):
            begin = 0
            for m in _NEXT_OBJECT.finditer(text, 1):
                in_string, brackets = _scan(text[begin : m.start()])
                if in_string or brackets[-1:] != ["["]:  # no comma within an object stands before a brace
                    yield Element(self.source, text[begin : m.start()], UNREADABLE)
                    begin = m.end()
                    if m["source"]:
                        self.source = _unescaped(m["source"])
            text = text[begin:]
            in_string, brackets = _scan(text + "}")
            if in_string or brackets:
                self.open = text
                return
        if self._state == IN_VALUE:
            self._state = IN_MAP
            yield Element(self.source, text + "}", NO_ARRAY)
        else:
            self._held = Element(self.source, text + "}", None)


def _unescaped(quoted: str) -> str:
    try:
        return json.loads(quoted, strict=False)
    except ValueError:
        return quoted[1:-1]


#: Elements of a batch of output; a batch of input may hold many times as many.
BATCH = 2000
ELEMENT = "source_key string, n long, element string, problem string"
PART = "lead string, left_open string, last_source string"


def split_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the elements of every document in ``value``, numbered from 0; a null has none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(batch.schema.names[1:])
            for row, text in enumerate(batch.column(0)):
                for n, element in enumerate(_elements_of(text.as_py() or "")):
                    out.add(row, n, element)
                    if len(out) == BATCH:
                        yield out.batch(batch, arrow)
                        out = _Rows(batch.schema.names[1:])
            yield out.batch(batch, arrow)

    chosen = docs.select("value", *keep)
    schema = StructType([*chosen.schema.fields[1:], *StructType.fromDDL(ELEMENT).fields])
    arrow = to_arrow_schema(schema)
    return chosen.mapInArrow(split, schema)


def _elements_of(text: str) -> Iterator[Element]:
    splitter, at = DocumentSplitter(), 0
    while (end := text.find("}", at)) >= 0:
        yield from splitter.piece(text[at:end])
        at = end + 1
    if at < len(text):
        yield from splitter.piece(text[at:])
    yield from splitter.end()


def split_files(pieces: DataFrame, *keep: str) -> DataFrame:
    """Elements of documents that are read in parts, with ``keep`` columns, and one row for each part.

    ``pieces`` has ``value`` and tells its part by ``path``, ``block`` (its first byte) and ``is_last``; rows of a part stand
    together and in order, as a scan yields them. ``n`` counts the elements of a part. The row of a part has no
    ``element`` but its PART columns.
    """
    names = ["path", "block", "is_last", *keep]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, part, n, first = None, None, 0, None

        def close(out: _Rows) -> None:
            nonlocal n
            for element in splitter.end() if part[2] else ():
                out.add(0, n, element)
                n += 1
            left = None if part[2] else splitter.left_open()
            out.part(0, n, "}".join(splitter.lead) if splitter.lead else None, left, splitter.source)

        for batch in batches:
            out = _Rows(names)
            for row, columns in enumerate(zip(*batch.columns[:4], strict=True)):
                value, *mine = (c.as_py() for c in columns)
                if mine != part:
                    if part is not None:
                        closing = _Rows(names)
                        close(closing)
                        yield closing.batch(first, arrow)
                    splitter, part, n, first = DocumentSplitter(mine[1] == 0), mine, 0, batch.slice(row, 1)
                for element in splitter.piece(value):
                    out.add(row, n, element)
                    n += 1
                    if len(out) == BATCH:
                        yield out.batch(batch, arrow)
                        out = _Rows(names)
            yield out.batch(batch, arrow)
        if part is not None:
            closing = _Rows(names)
            close(closing)
            yield closing.batch(first, arrow)

    chosen = pieces.select("value", *names)
    schema = StructType([*chosen.schema.fields[1:], *StructType.fromDDL(f"{ELEMENT}, {PART}").fields])
    arrow = to_arrow_schema(schema)
    return chosen.mapInArrow(split, schema)


class _Rows:
    """Output rows, each with the kept columns of an input row."""

    def __init__(self, keep: list[str]):
        self._keep = keep
        self._rows: list[int] = []
        self._new: list[tuple] = []

    def __len__(self) -> int:
        return len(self._rows)

    def add(self, row: int, n: int, element: Element) -> None:
        self._rows.append(row)
        self._new.append((element.source, n, element.text, element.problem, None, None, None))

    def part(self, row: int, n: int, lead: str | None, left_open: str | None, source: str | None) -> None:
        self._rows.append(row)
        self._new.append((None, n, None, None, lead, left_open, source))

    def batch(self, given: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        kept = [given.column(given.schema.get_field_index(name)).take(pa.array(self._rows, pa.int64())) for name in self._keep]
        columns = list(zip(*self._new)) or [()] * 7
        new = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(kept) :])]
        return pa.RecordBatch.from_arrays([*(k.cast(f.type) for k, f in zip(kept, schema)), *new], schema=schema)
