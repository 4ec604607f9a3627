"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition packs its pieces best-fit decreasing, emits the bins that are
nearly full, and passes its underfull bins on; a tree of rounds merges those of
`FAN_IN` partitions at a time, each bin now being one item, until one task is
left. Best fit leaves a task at most one bin that is half full or less, and two
bins over half never fit together; so a task need pass on only that bin and the
`SPARE` emptiest others, and no task gathers more than FAN_IN * (SPARE + 1).

Defined results: a null text is the empty text, one sequence token (the end
mark) long; rows with a null id are documents too; repeated rows are packed
as often as they come; an empty table packs to an empty table.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

CAPACITY, END_ID = 4096, 1
#: Bins with this share of their space used are nearly full.
NEARLY = 0.999
FAN_IN, SPARE = 8, 64
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a worker keeps; it forgets all of them beyond that.
WORDS_KEPT = 1_800_000
#: Characters that are encoded at a time; a text of more than LONG goes to the tokenizer whole.
CHUNK, LONG = 1 << 18, 4 << 20
_KIND = np.full(256, 2, np.int8)  # 0 white space, 1 full stop and comma, 3 letters and digits
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[44, 46]] = 1
_KIND[[*range(48, 58), *range(97, 123)]] = 3


class WordEncoder:
    """Token ids by the tokenizer, a word at a time, looked up by the words' hashes.

    The tokenizer joins nothing across white space, nor a letter or digit with a
    full stop or comma after it, and it lowers A-Z first; so texts are lowered
    and cut at those places. Texts with the marks of special tokens go to the
    tokenizer whole.
    """

    SLOTS = 1 << 22

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(self.SLOTS, -1, np.int32)
        self.keys = np.zeros(WORDS_KEPT, np.uint64)
        # Zeros take memory only once they are written to.
        self.first, self.number, self.ids = np.zeros(WORDS_KEPT, np.int64), np.zeros(WORDS_KEPT, np.int64), np.zeros(1 + 4 * WORDS_KEPT, "<u4")
        self.ids[0], self.number[0], self.known, self.used = END_ID, 1, 1, 1  # word 0 is the end mark

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's word, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at, todo = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42), np.arange(len(keys))
        while len(todo):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = slot[hit]
            left = (slot >= 0) & ~hit
            at, todo = (at[left] + np.uint64(1)) & np.uint64(self.SLOTS - 1), todo[left]
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids) // 2), "<u4")])
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), "<u4", total)
        new = np.arange(self.known, self.known + len(keys))
        self.keys[new], self.number[new], self.first[new] = keys, n, self.used + np.cumsum(n) - n
        self.known, self.used = self.known + len(keys), self.used + total
        at, todo = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42), new.astype(np.int32)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            at, todo = (at[left] + np.uint64(1)) & np.uint64(self.SLOTS - 1), todo[left]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end mark's last, as little-endian unsigned 32-bit numbers."""
        raw = [t.encode("utf-8").lower() for t in texts]
        whole = [i for i, t in enumerate(raw) if b"<|" in t or len(t) > LONG]
        for i in whole:
            raw[i] = b""
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        kind = _KIND[data]
        latin = (data >= 128) & (np.r_[np.uint8(0), data[:-1]] == 0xC3) & (data != 0x97) & (data != 0xB7)
        solid = (kind == 3) | latin
        inside = kind > 0
        before = np.r_[False, inside[:-1]]
        starts = np.flatnonzero(inside & (~before | ((kind == 1) & np.r_[False, solid[:-1]])))
        ends = np.r_[starts[1:], len(data)]
        gaps = np.flatnonzero(~inside & before)
        if len(starts):
            ends = np.minimum(ends, gaps[np.searchsorted(gaps, starts, side="right")])
        keys = wordhash.hash_spans(data, starts, ends - starts)
        if self.known + len(keys) > WORDS_KEPT:
            self.forget()
        place = self._places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            spans = new[at]
            self._learn(fresh, [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts[spans].tolist(), ends[spans].tolist())])
            place[new] = self._places(keys[new])
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        place = np.insert(place, np.searchsorted(starts, np.cumsum(sizes + 1) - 1), 0)
        n = self.number[place]
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.first[place] - (np.cumsum(n) - n), n)]
        last = np.cumsum(n)[np.flatnonzero(place == 0)]
        out = np.split(ids, last[:-1])
        for i in whole:
            out[i] = np.array([*self._ids_of(texts[i]), END_ID], "<u4")
        return out


def _encoder(path: str | None) -> WordEncoder:
    """The worker's encoder: one task's words serve the next, until another operator's tasks come."""
    return common.kept(("encoder", path), lambda: WordEncoder(path))


def _chunks(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        out.append(t or "")
        size += len(out[-1])
        if size >= CHUNK:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]): documents cut into pieces of at most `capacity` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for pdf in batches:
            for at, texts in _chunks(pdf["text"]):
                rows = []
                for doc, ids in zip(pdf["doc_id"].iloc[at : at + len(texts)], encoder.encode(texts)):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())) + ((part.astype("int32"),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return common.written(out.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, largest items first, each into the fullest bin that still holds it."""
    bins = np.empty(len(lengths), np.int64)
    spaces: list[int] = []  # the distinct free spaces of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(spaces, n)
        if at == len(spaces):
            chosen, space = count, capacity
            count += 1
        else:
            space = spaces[at]
            chosen = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space], spaces[at]
        bins[i] = chosen
        space -= n
        if space:
            if space not in open_bins:
                bisect.insort(spaces, space)
                open_bins[space] = []
            open_bins[space].append(chosen)
    return bins


def _round(items: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Best fit of each partition's items (total, uids, lengths); done tells the bins that go no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*batches, pd.DataFrame({"total": np.zeros(0, np.int64), "uids": [], "lengths": []})], ignore_index=True)
        if not len(pdf):
            return
        totals = pdf["total"].to_numpy(np.int64)
        bins = best_fit(totals, capacity)
        order = np.argsort(bins, kind="stable")
        filled = np.bincount(bins, weights=totals).astype(np.int64)
        done = filled >= NEARLY * capacity
        left = np.flatnonzero(~done)
        done[left[np.argsort(filled[left], kind="stable")[SPARE + 1 :]]] = True
        uids, lengths = pdf["uids"].tolist(), pdf["lengths"].tolist()
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0]), len(order)]
        for lo in range(0, len(bounds) - 1, 2000):
            groups = [order[bounds[g] : bounds[g + 1]] for g in range(lo, min(lo + 2000, len(bounds) - 1))]
            yield pd.DataFrame(
                {
                    "total": [int(filled[bins[g[0]]]) for g in groups],
                    "uids": [np.concatenate([uids[i] for i in g]) for g in groups],
                    "lengths": [np.concatenate([lengths[i] for i in g]) for g in groups],
                    "offsets": [np.cumsum(part) - part for part in (np.concatenate([lengths[i] for i in g]) for g in groups)],
                    "done": [bool(done[bins[g[0]]]) or last for g in groups],
                }
            )

    return common.written(items.select("total", "uids", "lengths").mapInPandas(run, "total long, uids array<long>, lengths array<long>, offsets array<long>, done boolean"), "bins")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with uid and length) with each piece's sequence_id and offset."""
    items = cut.where(F.col("length") < capacity).select(F.col("length").alias("total"), F.array("uid").alias("uids"), F.array("length").alias("lengths"))
    partitions = items.rdd.getNumPartitions()
    bins: list[DataFrame] = []
    while True:
        now = _round(items, capacity, last=partitions <= 1)
        bins.append(now.where("done"))
        if partitions <= 1:
            break
        partitions = -(-partitions // FAN_IN)
        items = now.where("not done").repartition(partitions)
    closed = bins[0]
    for more in bins[1:]:
        closed = closed.union(more)
    member = closed.select(F.col("uids")[0].alias("sequence_id"), F.explode(F.arrays_zip("uids", "offsets")).alias("at"))
    member = member.select(F.col("at.uids").alias("uid"), "sequence_id", F.col("at.offsets").alias("offset"))
    rest = cut.where(F.col("length") < capacity).join(member, "uid")
    whole = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    return rest.unionByName(whole)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    return packed(pieces(docs, id_col, text_col, capacity, path, with_ids), capacity)
