"""Language-model scoring by context-tree weighting over bytes, beside a word unigram base.

Each byte is eight binary decisions; a decision's nodes are those of the 0 to
`DEPTH` bytes before it, with the byte's bits so far. Every node holds a
Krichevsky-Trofimov estimate of its training counts, and the weighting
P_w = (P_kt + product of the children's P_w) / 2 gives each node the posterior
weight of stopping there. A text's probability mixes, bit by bit, the estimates
of all depths by those weights, up to the deepest node that training saw.

Training counts (DEPTH + 1)-grams of bytes and words, over all training texts,
as distributed tables. The tree is weighted by task in groups of contexts that
share their last two bytes; only nodes of under two bytes (at most 65,792 x 255)
meet in one place. The tables go to the workers in passes of at most
`PASS_ENTRIES` entries, each pass holding some of the two-byte contexts and
words; every byte and word is scored in exactly one pass, so any size of model
gives the same scores in bounded memory.

Defined results: a null text is the empty text, one end mark; a text is its
bytes with A-Z lowered, then byte 0 as its end, after zeros; repeated rows count
and are scored as often as they come; with no training text every bit costs one
bit, and the base is one token's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

DEPTH = 5
#: Table entries that one scoring pass may hold in a worker, of 12 to 24 bytes each.
PASS_ENTRIES = 5_000_000
SHARDS = 256
#: Bytes of text at a time; arrays of some twenty times that come and go.
CHUNK = 1 << 18
LOG_HALF = float(np.log(0.5))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def batches_of(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lowered texts) of CHUNK bytes or a little more at a time."""
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        out.append(lowered(t))
        size += len(out[-1])
        if size >= CHUNK:
            yield at, out
            at, size, out = i + 1, 0, []
    if out:
        yield at, out


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every byte's gram: the depth bytes before it and itself, number of them in each text, its end included)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    gap = b"\0" * depth
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    key = np.zeros(len(data) - depth, np.uint64)
    for j in range(depth + 1):
        key = (key << np.uint64(8)) | data[j : j + len(key)]
    first = np.cumsum(n + depth - 1) - (n + depth - 1)
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    return key[at], n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.diff(np.r_[at, len(keys)])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series eight steps up."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(product)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - float(np.log(np.pi))


class Level:
    """The nodes of one depth, by key (context << 8 | 1 and the bits so far): counts of next bits 0 and 1."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        node, zero, one = [], [], []
        for j in range(8):
            prefix = (keys >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
            at = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]][: len(prefix)])
            bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            node.append(prefix[at])
            one.append(np.add.reduceat(np.where(bit, n, 0), at) if len(at) else n[:0])
            zero.append((np.add.reduceat(n, at) if len(at) else n[:0]) - one[-1])
        node = np.concatenate(node)
        order = np.argsort(node, kind="stable")
        self.node = node[order]
        self.zero, self.one = (np.concatenate(x)[order].astype(float) for x in (zero, one))
        self.kt = (self.one + 0.5) / (self.zero + self.one + 1)
        self.log_pw = log_kt(self.zero, self.one)
        self.stop = np.ones(len(self.node))

    def weight(self, children: np.ndarray) -> None:
        """Mix with the summed log P_w of each node's children."""
        own, below = LOG_HALF + self.log_pw, LOG_HALF + children
        self.log_pw = np.logaddexp(own, below)
        self.stop = np.exp(own - self.log_pw)


def levels_of(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels depth to top of the tree over grams of distinct keys, weighted from the leaves up."""
    out: list[Level] = []
    for d in range(depth, top - 1, -1):
        level = Level(*summed(keys & np.uint64((1 << (8 * (d + 1))) - 1), n))
        if out:
            below = out[-1]
            parent = np.searchsorted(level.node, below.node & np.uint64((1 << (8 * (d + 1))) - 1))
            level.weight(np.bincount(parent, weights=below.log_pw, minlength=len(level.node)))
        out.append(level)
    return out


def mixed(level: Level, depth: int, above: tuple | None) -> tuple:
    """(node, probability of a next 1 where the node is the deepest seen, stopped mass times estimate, mass left) by node.

    above is the same of the depth over it, or None for depth 0.
    """
    if above is None:
        spent, left = np.zeros(len(level.node)), np.ones(len(level.node))
    else:
        node, _, spent, left = above
        at = np.searchsorted(node, level.node & np.uint64((1 << (8 * depth)) - 1))
        spent, left = spent[at], left[at]
    return level.node, spent + left * level.kt, spent + left * level.stop * level.kt, left * (1 - level.stop)


def signed(p: np.ndarray) -> np.ndarray:
    """Probabilities as small floats: above a half, less the rest to 1, which would else round to none of it."""
    return np.where(p > 0.5, p - 1, p).astype(np.float32)


def costs(keys: np.ndarray, node: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 probability of each seen gram's byte: its bits at the deepest nodes."""
    out = np.zeros(len(keys))
    for j in range(8):
        prefix = (keys >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
        q = p[np.searchsorted(node, prefix)]
        out += np.log10(np.where((keys >> np.uint64(7 - j)) & np.uint64(1), q, 1 - q))
    return out


class Table:
    """Numbers by 64-bit key; open addressing, looked up many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        at, todo = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            at, todo = (at[left] + np.uint64(1)) & self.mask, todo[left]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            slot = self.slots[at]
            hit = (self.keys[slot] == keys[todo]) & (slot >= 0)
            out[todo[hit]] = slot[hit]
            left = ~hit & (slot >= 0)
            at, todo = (at[left] + np.uint64(1)) & self.mask, todo[left]
        return out


def _tag(node: np.ndarray, depth: int) -> np.ndarray:
    return node | np.uint64(depth << 56)


def _shards_of_contexts(shards: int) -> np.ndarray:
    """The shard of each pair of last context bytes."""
    return (np.arange(65536, dtype=np.int64) * 40503 % 65536) * shards // 65536


def _shard_column(shards: int):
    gram = (F.shiftright("key", 8).bitwiseAND(F.lit(65535)) * 40503) % 65536
    return F.floor(F.when(F.col("word"), F.shiftrightunsigned("key", 48)).otherwise(gram) * shards / 65536).cast("int")


def counts(docs: DataFrame, text_col: str, depth: int) -> DataFrame:
    """(word, key, n): how often each gram of bytes (word false) and each word's hash comes in the rows of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.given_back()
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def merged(word: bool) -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([k for k, _ in held[word]]), np.concatenate([n for _, n in held[word]]))

        for pdf in batches:
            for _, texts in batches_of(pdf["text"]):
                held[False].append(counted(grams_of(texts, depth)[0]))
                held[True].append(counted(wordhash.words_of(texts, _SPACE)[0]))
                for word, parts in held.items():
                    if sum(len(k) for k, _ in parts[1:]) > 1_000_000 + len(parts[0][0]):
                        held[word] = [merged(word)]
        for word, parts in held.items():
            if parts:
                keys, n = merged(word)
                for i in range(0, len(keys), 200_000):
                    yield pd.DataFrame({"word": word, "key": keys[i : i + 200_000].view(np.int64), "n": n[i : i + 200_000]})
                parts.clear()
                del keys, n
        common.given_back()

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word boolean, key long, n long")
    # A task's keys are distinct as they are: dealt out first, they aren't put into tables of Spark's for nothing.
    rows = rows.repartition("word", "key")
    return common.written(rows.groupBy("word", "key").agg(F.sum("n").alias("n")), "ctw-counts")


class Model:
    """The trained tables: counts on disk, weights of the top levels here, passes of shards."""

    def __init__(self, docs: DataFrame, text_col: str = "text", depth: int = DEPTH, pass_entries: int = PASS_ENTRIES):
        self.depth = depth
        found = counts(docs, text_col, depth)
        self.texts = docs.count()
        sizes = {r["word"]: r for r in found.groupBy("word").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
        words = sizes.get(True, {"v": 0, "n": 0})
        grams = sizes.get(False, {"v": 0, "n": 0})
        self.tokens = words["n"] + self.texts
        self.vocabulary = words["v"] + (self.texts > 0)
        self.shards = min(65536, max(SHARDS, (words["v"] + grams["v"]) // 50_000))
        self.found = found.withColumn("shard", _shard_column(self.shards))
        self._weigh()
        self.passes = self._passes(pass_entries)

    def _weigh(self) -> None:
        """Levels 0 and 1 from the sums of level 2, which has at most 65536 * 255 nodes; and each shard's entries."""
        depth = self.depth

        def low(pdf: pd.DataFrame) -> pd.DataFrame:
            gram = ~pdf["word"].to_numpy(bool)
            keys, n = summed(pdf["key"].to_numpy(np.int64).view(np.uint64)[gram], pdf["n"].to_numpy(np.int64)[gram])
            levels = levels_of(keys, n, depth, 2)
            k3, n3 = summed(keys & np.uint64(0xFFFFFF), n)
            entries = [len(keys), sum(len(x.node) for x in levels), int((~gram).sum())]
            return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "entries": [entries], "keys": [k3.tobytes()], "n": [n3.tobytes()], "node": [levels[-1].node.tobytes()], "log_pw": [levels[-1].log_pw.tobytes()]})

        got = self.found.groupBy("shard").applyInPandas(low, "shard int, entries array<long>, keys binary, n binary, node binary, log_pw binary")
        self.entries, parts = {}, []
        for r in got.toLocalIterator():
            self.entries[r["shard"]] = r["entries"]
            parts.append([np.frombuffer(r[c], t) for c, t in (("keys", np.uint64), ("n", np.int64), ("node", np.uint64), ("log_pw", float))])
        keys, n, node, log_pw = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.uint64, float)))
        one, zero = (Level(*summed(keys & np.uint64((1 << (8 * (d + 1))) - 1), n)) for d in (1, 0))
        for level, mask, below in ((one, 0xFFFF, (node, log_pw)), (zero, 0xFF, None)):
            below = below or (one.node, one.log_pw)
            at = np.searchsorted(level.node, below[0] & np.uint64(mask))
            level.weight(np.bincount(at, weights=below[1], minlength=len(level.node)))
        first = mixed(zero, 0, None)
        self.above = mixed(one, 1, first)
        self.top = [(_tag(first[0], 0), signed(first[1])), (_tag(self.above[0], 1), signed(self.above[1]))]

    def _passes(self, most: int) -> list[list[int]]:
        out: list[list[int]] = [[]]
        size = 0
        # Shards that training didn't meet are scored in some pass too.
        for shard in range(self.shards):
            n = sum(self.entries.setdefault(shard, [0, 0, 0]))
            if size + n > most and out[-1]:
                out.append([])
                size = 0
            out[-1].append(shard)
            size += n
        return out

    def tables(self, shards: list[int]) -> dict:
        """What a scoring pass over these shards needs, gathered from them; bounded by the size of a pass."""
        depth, above = self.depth, self.above

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            word = pdf["word"].to_numpy(bool)
            key, n = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64)
            keys, m = summed(key[~word], n[~word])
            over, nodes, ps, cost = above, [], [], np.zeros(0)
            for d, level in zip(range(2, depth + 1), levels_of(keys, m, depth, 2)[::-1]):
                over = mixed(level, d, over)
                nodes.append(_tag(over[0], d))
                ps.append(signed(over[1]))
            cost = costs(keys, over[0], over[1]).astype(np.float32)
            return pd.DataFrame({"keys": [keys.tobytes()], "cost": [cost.tobytes()], "node": [np.concatenate(nodes).tobytes()], "p": [np.concatenate(ps).tobytes()], "words": [key[word].tobytes()], "n": [n[word].tobytes()]})

        rows = self.found.where(F.col("shard").isin(shards)) if len(self.passes) > 1 else self.found
        kinds = {"keys": np.uint64, "cost": np.float32, "node": np.uint64, "p": np.float32, "words": np.uint64, "n": np.int64}
        sizes = [self.entries[s] for s in shards]
        top = sum(len(node) for node, _ in self.top)
        lengths = dict(zip(kinds, (n for i, n in enumerate(map(sum, zip(*sizes))) for _ in (0, 1)))) if sizes else dict.fromkeys(kinds, 0)
        out = {c: np.empty(lengths[c] + top * (c in ("node", "p")), t) for c, t in kinds.items()}
        at = dict.fromkeys(kinds, 0)

        def put(c: str, values: np.ndarray) -> None:
            out[c][at[c] : at[c] + len(values)] = values
            at[c] += len(values)

        for node, p in self.top:
            put("node", node)
            put("p", p)
        for row in rows.groupBy("shard").applyInPandas(build, "keys binary, cost binary, node binary, p binary, words binary, n binary").toLocalIterator():
            for c, t in kinds.items():
                put(c, np.frombuffer(row[c], t))
        order = np.argsort(out["node"])
        out["node"], out["p"] = out["node"][order], out["p"][order]
        return out


def bits(keys: np.ndarray, depth: int, node: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of grams that training didn't see: each bit at its deepest node; p is signed()."""
    out = np.zeros(len(keys))
    context = keys >> np.uint64(8)
    for j in range(8):
        prefix = np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
        q, todo = np.full(len(keys), 0.5), np.arange(len(keys))
        for d in range(depth, -1, -1):
            if not len(todo) or not len(node):
                break
            want = _tag(((context[todo] & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix[todo], d)
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            hit = node[at] == want
            q[todo[hit]] = p[at[hit]]
            todo = todo[~hit]
        one = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(one == (q < 0), 1 - np.abs(q), np.abs(q)))
    return out


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, n_tokens, n_known, base_score, score) of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    depth, total = model.depth, float(np.log10(model.tokens + model.vocabulary + 1))
    end = (float(np.log10(model.texts + 1)), int(model.texts > 0))
    context_shard, shards = _shards_of_contexts(model.shards), model.shards
    several = len(model.passes) > 1
    if several:  # passes are added up by uid, which must be the same in each
        rows = common.written(rows, "ctw-rows")
    columns = f"uid long, id {kind}, n_tokens long, n_known long, base_score double, score double"
    out = None
    for i, part in enumerate(model.passes):
        held = docs.sparkSession.sparkContext.broadcast(model.tables(part))
        mine = np.zeros(shards, bool)
        mine[part] = True

        def run(batches: Iterator[pd.DataFrame], held=held, mine=mine, first=i == 0) -> Iterator[pd.DataFrame]:
            common.given_back()
            t = held.value
            if "grams" not in t:  # once in a worker's life with this broadcast
                t["grams"], t["known"] = Table(t["keys"], t["cost"]), Table(t["words"], t["n"])
            grams, words = t["grams"], t["known"]
            ours = mine[context_shard]
            for pdf in batches:
                for at, texts in batches_of(pdf["text"]):
                    key, n = grams_of(texts, depth)
                    doc = np.repeat(np.arange(len(texts)), n)
                    if several:
                        here = ours[(key >> np.uint64(8)) & np.uint64(0xFFFF)]
                        key, doc = key[here], doc[here]
                    found = grams.find(key)
                    value = grams.values[found].astype(float) if len(grams.values) else np.zeros(len(key))
                    new = np.flatnonzero(found < 0)
                    value[new] = bits(key[new], depth, t["node"], t["p"])
                    score = np.bincount(doc, weights=value, minlength=len(texts))
                    key, m = wordhash.words_of(texts, _SPACE)
                    doc = np.repeat(np.arange(len(texts)), m)
                    if several:
                        here = mine[((key >> np.uint64(48)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)]
                        key, doc = key[here], doc[here]
                    found = words.find(key)
                    doc, known = doc[found >= 0], words.values[found[found >= 0]]
                    base = np.bincount(doc, weights=np.log10(known + 1.0), minlength=len(texts))
                    n_known = np.bincount(doc, minlength=len(texts))
                    if first:
                        base, n_known = base + end[0] - (m + 1) * total, n_known + end[1]
                    rows_of = pdf.iloc[at : at + len(texts)]
                    yield pd.DataFrame({"uid": rows_of["uid"].to_numpy(), "id": rows_of["id"].to_numpy(), "n_tokens": m + 1, "n_known": n_known, "base_score": base, "score": score})
                    del key, n, doc, found, value, new, known
            common.given_back()

        # Written pass by pass, so that only one pass's tables are held at a time.
        scores = common.written(rows.mapInPandas(run, columns), "ctw-scores")
        held.destroy()
        out = scores if out is None else out.unionByName(scores)
    if not several:
        return out
    sums = [F.sum(c).alias(c) for c in ("n_known", "base_score", "score")]
    return out.groupBy("uid").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), *sums)
