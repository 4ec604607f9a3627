"""One JSON document read by many tasks: the objects of one of its arrays, by byte range.

Spark's text reader cuts the file after closing braces, wherever its blocks
begin. Whether a block begins inside a string, and how deep, isn't known there;
so a first pass takes, for each block, how quotes and brackets change both under
either assumption, and a fold over the blocks settles it. A second pass takes the
document's outline: all but the array's objects, how many of those begin in each
block, and the pieces of those that blocks cut, two a block at most. Outline and
pieces go to the driver, objects don't: a last, lazy pass cuts them out. A task
holds an Arrow batch, and an object that goes on in the next.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = b" \t\r\n"
#: Strings, and commas that cut-out objects leave behind.
_COMMAS = re.compile(r'"(?:[^"\\]|\\.)*"|\[(?:\s*,)+|,(?:\s*,)*(?=\s*(\]))|,(?:\s*,)+')
_TURN = np.zeros(256, np.int8)  # what a byte does to the depth
_TURN[[*b"{["]], _TURN[[*b"}]"]] = 1, -1


class ScanError(ValueError):
    """The document isn't what is asked for; `kind` is invalid, type or items."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of brackets, whether each is in a string, whether the end is), of bytes that begin in a string or not, and not after a backslash."""
    quotes = np.flatnonzero(data == 34)
    slash = data == 92
    if len(quotes) and slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # the last byte that is no backslash
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[((before - last[before]) % 2 == 0) | (quotes == 0)]
    at = np.flatnonzero(_TURN[data])
    return at, (np.searchsorted(quotes, at) + inside) % 2 == 1, bool((len(quotes) + inside) % 2)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes, bool]]:
    """(block, bytes, whether it is the block's first batch)."""
    last = None
    for pdf in batches:
        for block, rows in pdf.groupby("block", sort=False):
            yield int(block), ("}".join(rows["value"]) + "}").encode(), block != last
            last = block


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    own = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select("value", own["file_block_start"].alias("block"), own["file_size"].alias("size"))


def _states(fragments: DataFrame) -> tuple[dict[int, tuple[int, bool]], bool]:
    """(each block's depth at its beginning, and whether that is inside a string; whether the document ends in a brace of its own)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list[int]] = {}
        size = 0

        def sized() -> Iterator[pd.DataFrame]:
            nonlocal size
            for pdf in batches:
                size = int(pdf["size"].iloc[0]) if len(pdf) else size
                yield pdf

        for block, data, _ in _blocks(sized()):
            odd, out, within, n = totals.setdefault(block, [0, 0, 0, 0])
            raw = np.frombuffer(data, np.uint8)
            at, inside, odd = structure(raw, bool(odd))
            turn = _TURN[raw[at]].astype(np.int64)
            totals[block] = [int(odd), out + int(turn[~inside].sum()), within + int(turn[inside].sum()), n + len(data)]
        yield pd.DataFrame([(b, *t, size) for b, t in totals.items()], columns=["block", "odd", "out", "within", "n", "size"])

    depth, inside, total, size, states = 0, False, 0, 0, {}
    for r in fragments.mapInPandas(run, "block long, odd int, out long, within long, n long, size long").orderBy("block").toLocalIterator():
        states[r["block"]] = (depth, inside)
        depth, inside = depth + (r["within"] if inside else r["out"]), inside != bool(r["odd"])
        total, size = total + r["n"], r["size"]
    own = total - size not in (1, -2)  # the reader leaves out a byte order mark
    if inside or depth != (0 if own else -1) or not states:
        raise ScanError("invalid", "brackets or quotes don't match")
    return states, own


@dataclass
class Cutter:
    """Cuts a block's bytes into the objects of arrays at `level` and what is around them."""

    level: int
    depth: int
    inside: bool
    containers: int = 0
    open: str | None = None
    before: int = ord("}")  # the last byte that is no white space
    held: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.depth >= self.level:
            self.open = "lead"

    def feed(self, data: bytes) -> Iterator[tuple[str, int, bytes]]:
        """('object' or 'text' or 'lead', number of the container, bytes); an object that isn't closed yet is held."""
        raw = np.frombuffer(data, np.uint8)
        at, inside, self.inside = structure(raw, self.inside)
        at = at[~inside]
        turn = _TURN[raw[at]].astype(np.int64)
        depth = self.depth + np.cumsum(turn)
        container, begins, ends = (turn > 0) & (depth == self.level - 1), (turn > 0) & (depth == self.level), (turn < 0) & (depth == self.level - 1)
        marks = np.flatnonzero(container | begins | ends)
        cursor = 0
        for place, new, first in zip(at[marks].tolist(), container[marks].tolist(), begins[marks].tolist()):
            if new:
                self.containers += 1
            elif first:
                if data[place] == 123 and self._before(data, place) != 58:
                    yield "text", self.containers, data[cursor:place]
                    cursor, self.open = place, "object"
                else:
                    self.open = "value"  # of a key, or an array: part of the outline
            else:
                if self.open in ("object", "lead"):
                    yield self.open, self.containers, b"".join([*self.held, data[cursor : place + 1]])
                    cursor, self.held = place + 1, []
                self.open = None
        if len(depth):
            self.depth = int(depth[-1])
        rest = data[cursor:]
        if self.open in ("object", "lead"):
            self.held.append(rest)
        else:
            yield "text", self.containers, rest
        tail = data.rstrip(_SPACE)
        self.before = tail[-1] if tail else self.before

    def _before(self, data: bytes, place: int) -> int:
        while place and data[place - 1] in _SPACE:
            place -= 1
        return data[place - 1] if place else self.before


def _cut(batches: Iterator[pd.DataFrame], states: dict[int, tuple[int, bool]], level: int) -> Iterator[tuple[int, Cutter, str, int, bytes]]:
    """(block, cutter, kind, container, bytes), and kind 'end' after each block."""
    cutter, at = None, None
    for block, data, first in _blocks(batches):
        if first:
            if cutter:
                yield at, cutter, "end", 0, b""
            cutter, at = Cutter(level, *states[block]), block
        for kind, container, part in cutter.feed(data):
            yield block, cutter, kind, container, part
    if cutter:
        yield at, cutter, "end", 0, b""


def _outline(fragments: DataFrame, states: dict[int, tuple[int, bool]], level: int) -> pd.DataFrame:
    """Of each block: its text around objects, their numbers by container (JSON), containers, and the pieces that it begins and ends with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, counts, lead = [], Counter(), None
        for block, cutter, kind, container, part in _cut(batches, states, level):
            if kind == "lead":
                lead = part
            elif kind == "object":
                counts[container] += 1
            elif kind == "text":
                if part.strip(_SPACE + b","):
                    text.append(part)
            else:
                held, opened = b"".join(cutter.held), cutter.open
                if opened == "object":
                    counts[cutter.containers] += 1
                row = (block, b"".join(text), json.dumps(counts), cutter.containers, held if opened == "lead" else lead, held if opened == "object" else None, opened)
                yield pd.DataFrame([row], columns=["block", "text", "counts", "containers", "lead", "head", "open"])
                text, counts, lead = [], Counter(), None

    schema = "block long, text binary, counts string, containers long, lead binary, head binary, open string"
    return fragments.mapInPandas(run, schema).toPandas().sort_values("block", ignore_index=True)


def _container(outline: str, key: str) -> int:
    """The number of the container that is the value of a key of the document's object."""
    raw = np.frombuffer(outline.encode(), np.uint8)
    at, inside, _ = structure(raw, False)
    at = at[~inside]
    turn = _TURN[raw[at]].astype(np.int64)
    opens = at[(turn > 0) & (np.cumsum(turn) == 2)].tolist()
    for n, place in enumerate(opens, 1):
        name = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', raw[:place].tobytes())
        if name and json.loads(b'"' + name[1] + b'"') == key:
            return n
    raise ScanError("type", f"no array {key}")


def scan(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, dict | list]:
    """((pos, raw) of the objects of the document's array, or of the array that is the value of `key`, the rest of the document).

    The rest has no objects in that array, nor in other keys' arrays. Two passes run
    at once, the last when the rows are used.
    """
    level = 2 if key is None else 3
    fragments = _fragments(spark, path)
    states, own = _states(fragments)
    blocks = _outline(fragments, states, level)
    text, carried = [], None
    for r in blocks.itertuples():
        # What a block begins inside is part of the outline if the block before it left a value open.
        if r.lead is not None and carried == "value":
            text.append(r.lead)
        text.append(r.text)
        carried = carried if r.open == "lead" else r.open
    whole = b"".join(text).decode().lstrip("\ufeff \t\r\n")
    whole = _COMMAS.sub(lambda m: m[0] if m[0][0] == '"' else "[" if m[0][0] == "[" else "" if m[1] is not None else ",", whole if own else whole[:-1])
    try:
        rest = json.loads(whole)
    except json.JSONDecodeError as e:
        raise ScanError("invalid", f"no valid outline: {e}") from e
    if key is None and not isinstance(rest, list) or key is not None and not isinstance(rest, dict):
        raise ScanError("type", f"the document is no {'array' if key is None else 'object'}")
    items = rest if key is None else rest.get(key)
    if not isinstance(items, list):
        raise ScanError("type", f"no array {key}")
    if items:
        raise ScanError("items", "the array holds other items than objects")
    target = 1 if key is None else _container(whole, key)
    offsets, shifts, pieces, begun, seen = {}, {}, {}, 0, 0
    last = None  # the cut object that goes on
    for r in blocks.itertuples():
        offsets[int(r.block)], shifts[int(r.block)] = begun, seen
        if r.lead is not None and last is not None:
            pieces[last].append(r.lead)
        begun += json.loads(r.counts).get(str(target - seen), 0)
        seen += int(r.containers)
        if r.head is not None and seen == target:
            last = begun - 1
            pieces[last] = [r.head]
        elif r.open != "lead":
            last = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, at = [], 0, {}
        for block, _, kind, container, part in _cut(batches, states, level):
            if kind == "object" and container + shifts[block] == target:
                n = at.get(block, 0)
                rows.append((offsets[block] + n, part.decode()))
                at[block], size = n + 1, size + len(part)
                if size > 1 << 24:
                    yield pd.DataFrame(rows, columns=["pos", "raw"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["pos", "raw"])

    found = fragments.mapInPandas(run, "pos long, raw string")
    if pieces:
        found = found.union(spark.createDataFrame([(int(n), b"".join(parts).decode()) for n, parts in pieces.items()], "pos long, raw string"))
    return found, rest
