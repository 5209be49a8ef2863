"""Structured texts as rows: one for each document, with its leaves and the paths that lead to them.

A document is read by a small pull reader inside an Arrow batch, in one pass and with bounded nesting; what is done with the
leaves is left to DataFrames.  A step of a path is ".name" or "[place]".  Leaves are strings, other scalars, or
empty lists, mappings and values; a document that cannot be read has a reason and no leaf.

The YAML read here is the part that rules are written in: block mappings and sequences, plain, quoted and folded
scalars, lists in brackets, comments.  Anchors, aliases, tags, mappings in braces, several documents and tabs that
indent are refused; so are keys that stand twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 64
#: Documents of about so many leaves are sent on at a time.
BATCH = 4096
#: Plain scalars that are no strings.
_OTHER = re.compile(r"~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0x[0-9a-fA-F]+|0o[0-7]+|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")
_KEY = re.compile(r"""(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s:#]|:\S))*)[ \t]*:(?=\s|$)""")
_QUOTED = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""")
_REST = re.compile(r"\s*(?:\s#.*)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", " ": " ", "e": "\x1b", "a": "\a", "b": "\b"}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))")


class Unreadable(ValueError):
    """The reason for which a document is refused."""


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _ESCAPES:
            raise Unreadable("unknown escape")
        return _ESCAPES[m[3]]

    return _ESCAPE.sub(one, text[1:-1])


class _Yaml:
    def __init__(self, text: str) -> None:
        self.lines: list[tuple[int, str]] = []
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def _next(self) -> tuple[int, str] | None:
        """The indent and content of the next line that has any; the line stays."""
        while self.at < len(self.raw):
            line = self.raw[self.at]
            body = line.lstrip(" ")
            if body.strip() and not body.lstrip().startswith("#"):
                if body[0] == "\t":
                    raise Unreadable("a tab indents")
                if body.startswith(("---", "...")) and not body[3:].strip():
                    raise Unreadable("several documents")
                return len(line) - len(body), body.rstrip()
            self.at += 1
        return None

    def _take(self, indent: int, rest: str) -> None:
        """What is left of the present line stands for it, as if it began there."""
        self.raw[self.at] = " " * indent + rest

    def leaves(self) -> Iterator[tuple[list[str], str | None, str]]:
        first = self._next()
        if first is not None:
            yield from self._node(first[0], [])
            if self._next() is not None:
                raise Unreadable("a line that belongs to nothing")

    def _node(self, indent: int, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        if len(path) > MOST_DEPTH:
            raise Unreadable("nested too deeply")
        _, body = self._next()
        if body == "-" or body.startswith("- "):
            yield from self._items(indent, path)
        elif _KEY.match(body):
            yield from self._fields(indent, path)
        else:
            self.at += 1
            yield from self._scalar(body, indent - 1, path)

    def _items(self, indent: int, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        place = 0
        while (line := self._next()) is not None and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            here = [*path, f"[{place}]"]
            place += 1
            rest = line[1][1:].lstrip(" ")
            if not rest or rest.startswith("#"):
                self.at += 1
                yield from self._below(indent, here)
            elif rest == "-" or rest.startswith("- ") or _KEY.match(rest):
                inner = indent + len(line[1]) - len(rest)
                self._take(inner, rest)
                yield from self._node(inner, here)
            else:
                self.at += 1
                yield from self._scalar(rest, indent, here)
        if line is not None and line[0] > indent:
            raise Unreadable("a line that belongs to nothing")

    def _fields(self, indent: int, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        seen: set[str] = set()
        while (line := self._next()) is not None and line[0] == indent:
            m = _KEY.match(line[1])
            if not m:
                raise Unreadable("a line that is no field")
            key = m["key"] if m["key"][0] not in "\"'" else _unquoted(m["key"])
            if key in seen:
                raise Unreadable("a key that stands twice")
            seen.add(key)
            here, rest = [*path, "." + key], line[1][m.end() :].strip()
            self.at += 1
            if not rest or rest.startswith("#"):
                below = self._next()
                if below is not None and below[0] == indent and (below[1] == "-" or below[1].startswith("- ")):
                    yield from self._items(indent, here)
                else:
                    yield from self._below(indent, here)
            else:
                yield from self._scalar(rest, indent, here)
        if line is not None and line[0] > indent:
            raise Unreadable("a line that belongs to nothing")

    def _below(self, indent: int, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        below = self._next()
        if below is not None and below[0] > indent:
            yield from self._node(below[0], path)
        else:
            yield path, None, "other"

    def _scalar(self, text: str, indent: int, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        """text follows a key or dash of this indent; its next lines, if any, stand further in."""
        if m := re.fullmatch(r"([|>])([-+]?)[1-9]?([-+]?)(?:\s+#.*)?", text):
            yield path, self._block(indent, m[1] == ">", m[2] + m[3]), "string"
        elif text[0] in "\"'":
            m = _QUOTED.match(text)
            if not m or not _REST.match(text, m.end()):
                raise Unreadable("a quoted value that does not end on its line")
            yield path, _unquoted(m[0]), "string"
        elif text[0] == "[":
            yield from self._bracket(text, path)
        elif text[0] in "&*!{}%@`,]|>":
            raise Unreadable("a form of YAML that rules are not read in")
        else:
            parts = [re.sub(r"\s#.*", "", text).rstrip()]
            while (line := self._next()) is not None and line[0] > indent:
                if _KEY.match(line[1]):
                    raise Unreadable("a field within a plain value")
                parts.append(re.sub(r"\s#.*", "", line[1]).rstrip())
                self.at += 1
            plain = " ".join(parts)
            if re.search(r":(?:\s|$)", plain):
                raise Unreadable("a field within a plain value")
            yield path, plain, "other" if _OTHER.fullmatch(plain) else "string"

    def _block(self, indent: int, folded: bool, chomp: str) -> str:
        found: list[str] = []
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            found.append(line)
            self.at += 1
        inner = min((len(x) - len(x.lstrip(" ")) for x in found if x.strip()), default=0)
        while found and not found[-1].strip():
            found.pop()
        lines = [x[inner:] for x in found]
        text = re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines)).replace("\n\n", "\n") if folded else "\n".join(lines)
        return text if "-" in chomp or not text else text + "\n"

    def _bracket(self, text: str, path: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        at, place = 1, 0
        while True:
            at += len(text[at:]) - len(text[at:].lstrip())
            if text.startswith("]", at):
                if not _REST.match(text, at + 1):
                    raise Unreadable("text after a list")
                break
            m = _QUOTED.match(text, at) or re.compile(r"""[^\s,\[\]{}#&*!|>'"%@`][^,\[\]{}]*""").match(text, at)
            if not m or re.search(r":\s", m[0]) and m[0][0] not in "\"'":
                raise Unreadable("a list that is not read")
            value = m[0].rstrip()
            quoted = value[0] in "\"'"
            yield [*path, f"[{place}]"], _unquoted(value) if quoted else value, "string" if quoted or not _OTHER.fullmatch(value) else "other"
            place += 1
            at = m.end() + len(text[m.end() :]) - len(text[m.end() :].lstrip())
            if text.startswith(",", at):
                at += 1
            elif not text.startswith("]", at):
                raise Unreadable("a list that does not end on its line")
        if not place:
            yield path, None, "empty"


def yaml_leaves(text: str) -> list[tuple[list[str], str | None, str]]:
    """(path, value, kind) of each leaf; Unreadable if the text is not read whole."""
    return list(_Yaml(text).leaves())


SCHEMA = "doc string, part int, leaves array<struct<path:array<string>,value:string,kind:string>>, unread string"


def rows(parts: DataFrame, reader) -> DataFrame:
    """SCHEMA rows of parts(doc, part, text), one a document, by a reader from text to (path, value, kind).  What is asked
    of a document's leaves is a column of its row, so nothing is sorted or sent to put them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[tuple]) -> pa.RecordBatch:
            docs, places, leaves, unread = zip(*done)
            path, value, kind = zip(*(x for found in leaves for x in found)) if any(leaves) else ((), (), ())
            flat = pa.StructArray.from_arrays([pa.array(path, pa.list_(pa.string())), pa.array(value, pa.string()), pa.array(kind, pa.string())], names=["path", "value", "kind"])
            ends = pa.array(accumulate(map(len, leaves), initial=0), pa.int32())
            columns = [pa.array(docs, pa.string()), pa.array(places, pa.int32()), pa.ListArray.from_arrays(ends, flat), pa.array(unread, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "part", "leaves", "unread"])

        done: list[tuple] = []
        held = 0
        for b in batches:
            for doc, part, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    done.append((doc, part, reader(text), None))
                except Unreadable as e:
                    done.append((doc, part, [], str(e)))
                held += len(done[-1][2]) + 1
                if held >= BATCH:
                    yield batch(done)
                    done, held = [], 0
        if done:
            yield batch(done)

    return parts.select(F.col("doc").cast("string").alias("doc"), F.col("part").cast("int").alias("part"), "text").mapInArrow(run, SCHEMA)
