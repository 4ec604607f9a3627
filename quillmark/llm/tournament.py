"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups of documents.

Documents become byte-level token ids. Whole sequences are cut off first; what
is left of each document goes to a random group of about `GROUP_ITEMS`, and each
group is packed alone, in one task: first fit decreasing, where a tree of the
bins' largest free spaces finds the first bin that still holds an item. Then the
emptiest bins are cut up to fill the spaces of the others, and what remains of
the group, less than a sequence, becomes sequences whose lengths are powers of
two, which need no padding. So a document is cut at most at the end of each
whole sequence and where its rest fills a gap.

No group grows with the input, and no row is looked up again: the ids travel to
the group once, and each piece's checksum is taken there.

Defined results: a null text is the empty text, one token (the end mark) long;
rows with a null id are documents too, and repeated rows are packed as often as
they come; ties go to the row read first; texts of any length are cut into whole
sequences and a rest; columns other than id and text are not read, whatever
their names; an empty table packs to an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing, wordhash

CAPACITY, END_ID = 2048, packing.END_ID
VOCABULARY = "byte_bpe_50k.json"
#: Rests of documents that a group holds, about.
GROUP_ITEMS = 8192
SEED = 13

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = np.zeros(256, bool)  # ASCII letters and digits
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WIDE = np.zeros(256, bool)  # first bytes of white space beyond ASCII
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class ByteEncoder(packing.WordEncoder):
    """Token ids by the byte-level tokenizer, a stretch at a time, looked up by the stretches' hashes.

    The tokenizer joins nothing across the start of a single white space between two
    other characters, nor across its end if it isn't a space, nor a Latin letter or
    digit with a full stop or comma after it; texts are cut at those places. Texts
    with the marks of special tokens, and very long ones, go to the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers

        super().__init__(path or public_tokenizers.path(VOCABULARY))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end mark's last, as little-endian unsigned 32-bit numbers."""
        raw = [t.encode("utf-8") for t in texts]
        whole = [i for i, t in enumerate(raw) if b"<|" in t or len(t) > packing.LONG]
        for i in whole:
            raw[i] = b""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text_ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = self._starts(data, text_ends - sizes, text_ends)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        keys = wordhash.hash_spans(data, starts, ends - starts)
        if self.known + len(keys) > packing.WORDS_KEPT:
            self.forget()
        place = self._places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            spans = new[at]
            self._learn(fresh, [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts[spans].tolist(), ends[spans].tolist())])
            place[new] = self._places(keys[new])
        place = np.insert(place, np.searchsorted(starts, text_ends), 0)  # word 0 is the end mark
        n = self.number[place]
        total = np.cumsum(n)
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.first[place] - (total - n), n)]
        out = np.split(ids, total[np.flatnonzero(place == 0)][:-1])
        for i in whole:
            out[i] = np.array([*self._ids_of(texts[i]), END_ID], "<u4")
        return out

    @staticmethod
    def _starts(data: np.ndarray, text_starts: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        """Where the stretches of all texts begin; they cover every byte."""
        if not len(data):
            return np.zeros(0, np.int64)
        space, first = _SPACE[data], np.zeros(len(data), bool)
        filled = text_starts < text_ends
        first[text_starts[filled]] = True
        other = ~(space | _WIDE[data])
        alone = space & np.r_[False, ~space[:-1]] & np.r_[other[1:], False]
        alone[text_ends[filled] - 1] = False
        alone &= ~first
        latin = (data >= 128) & (np.r_[np.uint8(0), data[:-1]] == 0xC3) & (data != 0x97) & (data != 0xB7)
        word = np.r_[False, (_SOLID[data] | latin)[:-1]]
        after = np.r_[False, (alone & (data != 32))[:-1]]
        return np.flatnonzero(first | alone | after | ((data == 44) | (data == 46)) & word)


def _encoder(path: str | None) -> ByteEncoder:
    return common.kept(("byte-encoder", path), lambda: ByteEncoder(path))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, start, length, doc_tokens, ids_crc32, ids, rest): whole sequences of each document, and its rest with its ids as bytes.

    A row per document and cut, written once, so that uid stays the same when an
    executor is lost. ids are the little-endian unsigned ids, of two bytes if the
    largest of the row fits, else of four; whole sequences have them if with_ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for pdf in batches:
            for at, texts in packing._chunks(pdf["text"]):
                rows = []
                for doc, ids in zip(pdf["doc_id"].iloc[at : at + len(texts)], encoder.encode(texts)):
                    n = len(ids)
                    for start in range(0, n, capacity):
                        part = ids[start : start + capacity]
                        rest = len(part) < capacity
                        blob = (part.astype("<u2") if int(part.max()) < 1 << 16 else part).tobytes() if rest or with_ids else None
                        rows.append((doc, start, len(part), n, zlib.crc32(part.tobytes()), blob, rest))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "rest"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, rest boolean")
    return common.written(out.select(F.monotonically_increasing_id().alias("uid"), "*"), "cut")


class TournamentTree:
    """The free spaces of bins: each inner node holds the larger of its two, so that the first bin with room is found by going down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """Takes `length` from the first bin that has it, and names the bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < length:
                at += 1
        found = at - self.leaves
        best[at] -= length
        while at > 1:
            at //= 2
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; no item is longer than a bin."""
    bins = np.zeros(len(lengths), np.int64)
    tree = TournamentTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i] = tree.first_fit(int(lengths[i]))
    return bins


def placed(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of a group: first fit, then free spaces filled by cutting up the emptiest bins."""
    bins = first_fit_decreasing(lengths, capacity)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.argsort(-filled, kind="stable")
    whole, left = divmod(int(lengths.sum()), capacity)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Items in the order of their sequences; those of the fullest stay where they are.
    items = np.argsort(rank[bins], kind="stable")
    stay = rank[bins[items]] < whole
    used = [0] * whole
    out = []
    for i in items[stay].tolist():
        s, n = int(rank[bins[i]]), int(lengths[i])
        out.append((i, 0, n, s, used[s]))
        used[s] += n
    # The others' tokens, in this order, fill those sequences and then ones of a power of two.
    room = [(s, used[s], capacity - used[s]) for s in range(whole) if used[s] < capacity]
    for power in range(left.bit_length() - 1, -1, -1):
        if left >> power & 1:
            room.append((room[-1][0] + 1 if room and room[-1][0] >= whole else whole, 0, 1 << power))
    at = 0
    for i in items[~stay].tolist():
        start, n = 0, int(lengths[i])
        while start < n:
            s, offset, space = room[at]
            take = min(space, n - start)
            out.append((i, start, take, s, offset))
            start += take
            room[at] = (s, offset + take, space - take)
            at += take == space
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of the rows of cut()."""
    rests = rows.where("rest")
    groups = max(1, -(-rests.count() // group_items))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        blobs = pdf["ids"].tolist()
        docs, starts, crcs, tokens = pdf["doc_id"].astype("Int64"), pdf["start"].to_numpy(), pdf["ids_crc32"].to_numpy(), pdf["doc_tokens"].to_numpy()
        parts = placed(lengths, capacity)
        item = np.array([p[0] for p in parts], np.int64)
        within, length, sequence, offset = np.array([p[1:] for p in parts], np.int64).T
        crc, ids = crcs[item], []
        for k, i in enumerate(item.tolist()):
            width = len(blobs[i]) // int(lengths[i])
            part = blobs[i][width * within[k] : width * (within[k] + length[k])]
            if length[k] < lengths[i]:
                crc[k] = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
            ids.append(part if with_ids else None)
        return pd.DataFrame({
            "doc_id": docs.iloc[item].to_numpy(), "start": starts[item] + within, "length": length, "ids_crc32": crc, "doc_tokens": tokens[item],
            "sequence_id": 2 * ((int(key[0]) << 32) + sequence) + 1, "offset": offset, "ids": ids,
        }).astype({"doc_id": "Int64"})

    group = F.pmod(F.xxhash64("uid", F.lit(SEED)), F.lit(groups)).alias("group")
    out = rests.select(group, "uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids").groupBy("group").applyInPandas(run, schema)
    whole = rows.where("not rest").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    out = out.union(whole)
    return out if with_ids else out.drop("ids")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequences; with_ids adds each piece's ids, as cut() writes them."""
    return packed(cut(docs, id_col, text_col, capacity, path, with_ids), capacity, with_ids=with_ids)
